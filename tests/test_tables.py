"""Sinks, look-ups, paging, plans and streams on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from mailloom.operators import events, importing, lookups, ordering, plan_steps, upsert
from mailloom.sources.messages import stream_messages
from mailloom.sources.tables import EmailTable, PointTable
from mailloom.streaming import jobs as streams


def emails(spark, ids, body="b"):
    rows = [(i, f"m{i}", f"t{i % 3}", "S", "s@x.yz", body) for i in ids]
    df = spark.createDataFrame(rows, "arrival long, external_message_id string, external_thread_id string, subject string, sender string, body_text string")
    df = df.withColumns(
        {"recipients": F.lit("r"), "body_html": F.lit(None).cast("string"), "sent_at": F.timestamp_seconds(F.col("arrival")), "has_attachments": F.lit(False)}
    )
    return importing.to_email_rows(df, F.timestamp_seconds(F.col("arrival")))


@pytest.fixture
def table(spark, tmp_path):
    return EmailTable(spark, str(tmp_path / "emails"), digits=1)


def ids(df):
    return sorted(int(r[0][1:]) for r in df.select("external_message_id").collect())


def test_insert_update_delete(spark, table):
    assert table.read().count() == 0
    assert table.insert_if_absent(emails(spark, range(10))) == 10
    assert table.insert_if_absent(emails(spark, range(5, 15))) == 5
    assert ids(table.read()) == list(range(15))
    some = emails(spark, [3, 4, 99]).select("id", F.lit("new").alias("body_cleaned"))
    table.update_bodies(some)
    assert ids(table.read().filter("body_cleaned = 'new'")) == [3, 4] and table.read().count() == 15
    table.update_bodies(emails(spark, [3]).select("id", F.lit(None).cast("string").alias("body_cleaned")))
    assert ids(table.read().filter("body_cleaned is null")) == [3]
    table.delete(emails(spark, [0, 1, 99]))
    assert ids(table.read()) == list(range(2, 15))
    table.delete(emails(spark, range(15)))
    assert table.read().count() == 0


def test_lookup_by_id_reads_one_bucket(spark, table):
    table.append(emails(spark, range(40)))
    one = lookups.by_external_id(table.read(), "m7", bucket_digits=1)
    assert one.first()["external_message_id"] == "m7"
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert lookups.by_external_id(table.read(), "absent").count() == 0
    twice = table.read().union(table.read())
    with pytest.raises(Exception, match="more than one row"):
        lookups.by_external_id(twice, "m7").collect()
    assert lookups.duplicate_ids(twice).count() == 40


def test_listings(spark):
    df = emails(spark, range(30))
    assert ids(lookups.recent(df, 3)) == [27, 28, 29]
    assert ids(lookups.by_thread(df, "t1", 2)) == [25, 28]
    assert ids(lookups.newest_per(df, "external_thread_id", 1)) == [27, 28, 29]
    assert ids(lookups.latest(df)) == [29] and lookups.latest(df.filter("false")).count() == 0
    assert ids(lookups.by_external_ids(df, ["m1", "zz"])) == [1]
    assert ids(lookups.by_external_ids(df, df.filter("arrival < 2"))) == [0, 1]
    assert "TakeOrderedAndProject" in lookups.recent(df)._jdf.queryExecution().executedPlan().toString()


def test_row_index_and_pages(spark):
    df = spark.range(0, 1000, 1, 7).select(((F.col("id") * 7919) % 1000).alias("k"))
    indexed = ordering.with_row_index(df, "k")
    assert indexed.filter("row_index = k").count() == 1000
    batches = ordering.with_batch_number(df, 300, "k").groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in batches] == [300, 300, 300, 100]
    assert sorted(r["k"] for r in ordering.deep_page(df, 3, 500, "k").collect()) == [500, 501, 502]
    assert [r["k"] for r in ordering.bounded_scan(df, 10, 4, 2, "k").collect()] == [8, 9]
    assert ordering.bounded_scan(df, 10, 4, 3, "k").count() == 0
    with pytest.raises(ValueError):
        ordering.bounded_scan(df, 0, 4, 0, "k")


def points(spark, rows):
    return spark.createDataFrame(
        [(i, (m, k, t), [1.0]) for i, m, k, t in rows],
        "id string, payload struct<external_message_id:string,chunk_index:int,chunk_text:string>, vector array<float>",
    )


def test_point_upserts(spark, tmp_path):
    old = points(spark, [("1", "a", 0, "x"), ("2", "a", 1, "x"), ("3", "b", 0, "x")])
    new = points(spark, [("1", "a", 0, "y"), ("4", "c", 0, "y")])
    texts = lambda df: {r["id"]: r["payload"]["chunk_text"] for r in df.collect()}
    merged = {"1": "y", "2": "x", "3": "x", "4": "y"}
    assert texts(upsert.upsert_points(old, new)) == merged
    assert texts(upsert.upsert_points(old, new, replace_emails=True)) == {"1": "y", "3": "x", "4": "y"}
    table = PointTable(spark, str(tmp_path / "points"))
    assert table.read().count() == 0 and table.upsert(old) == 3 and table.upsert(new) == 2
    assert texts(table.read()) == merged
    assert texts(PointTable(spark, table.path).read()) == merged


def test_events(spark):
    rows = [
        ("1", "A <a@b.co>", "Task", "do it", "body"),
        ("2", "A <a@b.co>", "Re: HITL_RESPONSE", "t-1", "body"),
        ("3", "nobody", "hitl_response", "t-1", "body"),
        ("4", "in@corp.co", None, "s", "body"),
    ]
    df = spark.createDataFrame(rows, "message_id string, sender string, subject string, snippet string, body string")
    got = {r["message_id"]: r for r in events.to_events(df).collect()}
    assert got["1"]["type"] == "new_request" and got["2"]["type"] == "hitl_response" and got["3"]["type"] == "new_request"
    assert got["2"]["thread_id"] == "t-1" and got["2"]["content"]["sender"] == "a@b.co"
    assert got["3"]["sender"] is None and got["4"]["type"] == "new_request"
    kinds = {r["message_id"]: r["sender_type"] for r in streams.classify(df, "in@corp.co").collect()}
    assert kinds == {"1": "external", "2": "external", "4": "internal"}


def test_plan_steps(spark):
    step = "struct<step_index:int,status:string,type:string>"
    rows = [
        (1, [(0, "completed", "send_email"), (1, "pending", "do_nothing"), (2, "pending", "send_email")]),
        (2, [(0, "completed", "send_email")]),
        (3, []),
    ]
    df = spark.createDataFrame(rows, f"plan_id int, steps array<{step}>").orderBy("plan_id")
    nxt = [r[0] and r[0]["step_index"] for r in df.select(plan_steps.next_pending(F.col("steps"))).collect()]
    assert nxt == [1, None, None]
    routes = [r[0] for r in df.select(plan_steps.route_after_dispatch(F.col("steps"))).collect()]
    assert routes == ["dispatch_execution_plan_step", "shutdown", "shutdown"]
    done = df.filter("plan_id = 1").select(plan_steps.mark_completed(F.col("steps"), F.lit(1)).alias("s")).first()["s"]
    assert [s["status"] for s in done] == ["completed", "completed", "pending"]
    with pytest.raises(Exception, match="no step"):
        df.filter("plan_id = 2").select(plan_steps.mark_completed(F.col("steps"), F.lit(5))).collect()
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        spark.range(1).select(plan_steps.merge_results(F.create_map(F.lit("1"), F.col("id")), F.create_map(F.lit("1"), F.col("id")))).collect()


def test_number_steps(spark):
    suggested = "array<struct<type:string,summary:string,reason:string,action_spec:string>>"
    df = spark.createDataFrame([(1, "why", [("send_email", "s", "r", "{}"), ("do_nothing", "s2", "r", "{}")])], f"plan_id int, ordering_reason string, suggested_steps {suggested}")
    want = [(0, "pending", "send_email"), (1, "pending", "do_nothing")]
    rows = plan_steps.number_steps(df).orderBy("step_index").collect()
    assert [(r["step_index"], r["status"], r["type"]) for r in rows] == want
    record = df.select(plan_steps.numbered(F.col("suggested_steps")).alias("steps"))
    assert [(s["step_index"], s["status"], s["type"]) for s in record.first()["steps"]] == want


def test_few_repeats_do_not_move_the_rows(spark, tmp_path):
    df = emails(spark, range(50)).union(emails(spark, [7]).withColumn("arrival", F.lit(99).cast("long")))
    df.write.parquet(str(tmp_path / "rows"))
    written = spark.read.parquet(str(tmp_path / "rows"))
    kept = importing.keep_one_per_key(written)
    assert kept.count() == 50 and kept.filter("arrival = 99").count() == 0
    assert importing.keep_one_per_key(written, newest=True).filter("arrival = 99").count() == 1
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_batch_lookup_does_not_move_the_table(spark, tmp_path):
    emails(spark, range(50)).write.parquet(str(tmp_path / "table"))
    emails(spark, [1, 2, 60]).write.parquet(str(tmp_path / "new"))
    table, new = (spark.read.parquet(str(tmp_path / n)) for n in ("table", "new"))
    found = importing.existing_ids(table, new)
    assert ids(found) == [1, 2] and ids(importing.insert_if_absent(table, new)) == [60]
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_import_stream_restarts_without_repeats(spark, tmp_path):
    import base64
    import json

    folder = tmp_path / "dump"
    folder.mkdir()
    table = EmailTable(spark, str(tmp_path / "emails"), digits=1)

    def dump(name, ids_):
        message = base64.urlsafe_b64encode(b"From: a@b.co\n\nx").decode()
        (folder / name).write_text("\n".join(json.dumps({"id": i, "threadId": "t", "raw": message}) for i in ids_))

    def run():
        streams.import_stream(stream_messages(spark, str(folder)), table, str(tmp_path / "check")).awaitTermination()

    dump("1.json", ["m1", "m2", "m2"])
    run()
    assert ids(table.read()) == [1, 2]
    dump("2.json", ["m2", "m3"])
    run()
    assert ids(table.read()) == [1, 2, 3]


def test_insert_of_repeats(spark, table):
    rows = emails(spark, [1, 1, 2]).unionByName(emails(spark, [1], body="later").withColumn("created_at", F.timestamp_seconds(F.lit(99))))
    nameless = emails(spark, [7, 8]).withColumn("external_message_id", F.lit(None).cast("string"))
    assert table.insert_if_absent(rows) == 2 and table.insert_if_absent(rows) == 0
    assert [r["body_text"] for r in table.read().orderBy("external_message_id").collect()] == ["b", "b"]
    assert table.insert_if_absent(nameless) == 2


def test_insert_reads_only_its_buckets(spark, table):
    table.append(emails(spark, range(40)))
    batch = emails(spark, [3])
    buckets = table._buckets_of(batch)
    plan = table.read().filter(F.col("bucket").isin(buckets))._jdf.queryExecution().executedPlan().toString()
    assert len(buckets) == 1 and "PartitionFilters: [isnotnull(bucket" in plan


def test_settings_stay_with_the_table(spark, table):
    table.append(emails(spark, range(8)))
    again = EmailTable(spark, table.path)
    assert again.digits == 1
    again.delete(emails(spark, range(3)))
    assert ids(again.read()) == list(range(3, 8))
    with pytest.raises(ValueError, match="digits=1"):
        EmailTable(spark, table.path, digits=2)


def test_repeated_updates(spark, table):
    table.append(emails(spark, range(8)))
    one = emails(spark, [3]).select("id", F.lit("x").alias("body_cleaned"), F.lit(1).alias("n"))
    two = one.withColumns({"body_cleaned": F.lit("y"), "n": F.lit(2)})
    table.update_bodies(one.union(one))
    table.update_bodies(two.union(one), order="n")
    assert table.read().count() == 8 and ids(table.read().filter("body_cleaned = 'y'")) == [3]
    with pytest.raises(Exception, match="different updates"):
        table.update_bodies(one.union(two))
    assert table.read().count() == 8


def test_bodies_of_updates_are_compared_only_if_ids_repeat(spark, table, monkeypatch):
    """Ids alone tell it, and an old body that equals the text is not moved beside it."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = emails(spark, range(4))
    updates = rows.select("id", F.lit("x").alias("body_cleaned"))
    assert "Aggregate" not in plan(upsert.update_bodies(rows, updates, ids_differ=True))
    assert "Aggregate" in plan(upsert.update_bodies(rows, updates))
    asked, real = [], upsert.update_bodies
    monkeypatch.setattr(upsert, "update_bodies", lambda *args, **options: asked.append(options["ids_differ"]) or real(*args, **options))
    bodies = lambda: {r[0]: r[1:] for r in table.read().select("external_message_id", "body_text", "body_cleaned").collect()}
    old = F.when(F.col("external_message_id") == "m0", None).when(F.col("external_message_id") == "m1", "c").otherwise(F.col("body_cleaned"))
    table.append(rows.withColumn("body_cleaned", old))
    table.append(emails(spark, [4, 5], None).withColumn("body_cleaned", F.when(F.col("arrival") == 5, "c")))
    before = {"m0": ("b", None), "m1": ("b", "c"), "m2": ("b", "b"), "m3": ("b", "b"), "m4": (None, None), "m5": (None, "c")}
    assert bodies() == before
    table.update_bodies(updates.join(emails(spark, [3]).select("id"), "id"))
    assert bodies() == {**before, "m3": ("b", "x")}
    none = emails(spark, [1, 2, 99]).select("id", F.lit(None).cast("string").alias("body_cleaned"))
    table.update_bodies(none.union(none))
    table.update_bodies(emails(spark, [4]).select("id", F.lit("y").alias("body_cleaned")))
    assert bodies() == {**before, "m1": ("b", None), "m2": ("b", None), "m3": ("b", "x"), "m4": (None, "y")}
    assert asked == [True, False, True]


def test_failed_replacement_keeps_a_copy(spark, table, monkeypatch):
    table.append(emails(spark, range(8)))
    monkeypatch.setattr(table, "_write", lambda rows, mode: 1 / 0)
    with pytest.raises(RuntimeError, match="a full copy of the rows is kept in (.*)") as error:
        table.delete(emails(spark, [3]))
    folder = str(error.value).rsplit(" ", 1)[1]
    touched = spark.read.parquet(folder).count()
    assert touched and "m3" not in {r[0] for r in spark.read.parquet(folder).select("external_message_id").collect()}


def test_compact_emails(spark, table):
    for k in range(4):
        table.append(emails(spark, [k]).withColumn("id", F.concat(F.lit("a"), "id")))
    assert table.compact(max_files=2) == ["a"]
    assert table.read().select(F.input_file_name()).distinct().count() == 1 and ids(table.read()) == [0, 1, 2, 3]


def vector_points(spark, rows):
    return spark.createDataFrame(
        [(i, (e, 0, t), v) for i, e, t, v in rows],
        "id string, payload struct<external_message_id:string,chunk_index:int,chunk_text:string>, vector array<float>",
    )


def test_points_of_one_batch(spark, tmp_path):
    table = PointTable(spark, str(tmp_path / "points"), dim=2, buckets=4)
    both = vector_points(spark, [("a", "m", "old", [1.0, 0.0]), ("a", "m", "new", [0.0, 1.0]), ("b", "m", "b", [1.0]), ("c", "n", "c", [1.0, 1.0])])
    numbered = both.withColumn("n", F.when(F.col("payload.chunk_text") == "new", 2).otherwise(1))
    assert table.upsert(numbered, order="n") == 2
    texts = lambda: {r["id"]: r["payload"]["chunk_text"] for r in table.read().collect()}
    assert texts() == {"a": "new", "c": "c"}
    assert [(r["id"], r["reason"]) for r in table.rejected().collect()] == [("b", "vector size is not 2")]
    table.upsert(both)
    assert table.read().count() == 2
    table.upsert(vector_points(spark, [("d", "m", "d", [1.0, 1.0])]), replace_emails=True)
    assert texts() == {"c": "c", "d": "d"}
    for k in range(4):
        table.upsert(vector_points(spark, [("e", "m", str(k), [1.0, 1.0])]))
    assert texts() == {"c": "c", "d": "d", "e": "3"}
    spark.sql(f"drop table {table._name(table._settled('rows', None, None))}")
    assert PointTable(spark, str(tmp_path / "points")).read().count() == 3
    folders = [p for p in (tmp_path / "points").iterdir() if p.is_dir()]
    assert len(folders) == 1 and len(list(folders[0].glob("*.parquet"))) <= 4
    with pytest.raises(ValueError, match="dim=2"):
        PointTable(spark, str(tmp_path / "points"), dim=3)


def test_jobs_leave_no_work_folders(spark, tmp_path, monkeypatch):
    from mailloom import session
    from mailloom.operators.embedding import hashing_encoder
    from mailloom.plans import jobs

    shared = tmp_path / "work"
    shared.mkdir()
    monkeypatch.setattr(session, "shared_root", lambda _: str(shared))
    table = EmailTable(spark, str(tmp_path / "emails"), digits=1)
    raw = spark.createDataFrame([(k, f"m{k}", "t", "RnJvbTogYUBiLmMKCmhp") for k in range(5)] + [(9, "x", "t", "!")], "arrival long, id string, threadId string, raw string")
    counters = jobs.import_messages(raw, table).first()
    assert (counters["created"], counters["skipped"]) == (5, 1) and table.rejected().count() == 1
    jobs.clean_into(table)
    assert jobs.clean_into(table) == {"processed": 5, "updated": 0}
    points_ = PointTable(spark, str(tmp_path / "points"), dim=64)
    jobs.vectorize_emails(table.read(), points_, hashing_encoder(64), replace_emails=True)
    jobs.vectorize_emails(table.read(), points_, hashing_encoder(64))
    assert points_.read().count() == 5
    assert list(shared.iterdir()) == []


def test_page_index_has_no_wide_column(spark, tmp_path):
    emails(spark, range(50)).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    plan = ordering._ranges(df.select("arrival"), "arrival")._jdf.queryExecution().executedPlan().toString()
    assert "body_text" not in plan
    assert sorted(r["arrival"] for r in ordering.deep_page(df, 7, 30, "arrival").collect()) == list(range(30, 37))


def test_answers_wait_without_limit(spark, tmp_path):
    """Requests and responses years apart, in either order, over several batches."""
    schema = "thread_id string, message_id string, type string, ts timestamp"
    source, out = (str(tmp_path / n) for n in ("in", "out"))
    day = lambda n: F.timestamp_seconds(F.lit(86400 * n))

    def feed(*rows):
        one = [spark.createDataFrame([r[:3]], "thread_id string, message_id string, type string").withColumn("ts", day(r[3])) for r in rows]
        for df in one:
            df.write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        streams.resume_stream(stream, out, str(tmp_path / "check")).awaitTermination()
        pairs = spark.read.schema("request_id string, response_id string").parquet(out)
        return sorted((r["request_id"], r["response_id"]) for r in pairs.collect())

    assert feed(("t", "q1", "new_request", 1), ("u", "r2", "hitl_response", 900)) == []
    assert feed(("u", "q2", "new_request", 2)) == [("q2", "r2")]
    assert feed(("t", "r1", "hitl_response", 1200), ("t", "r0", "hitl_response", 0)) == [("q1", "r1"), ("q2", "r2")]
    with pytest.raises(ValueError, match="resume_stream"):
        streams.resume(spark.readStream.schema(schema).parquet(source), spark.read.schema(schema).parquet(source))


def test_plans_advance_in_any_order(spark, tmp_path):
    """Steps and results shuffled over batches and restarts, against the steps of each plan taken together."""
    from mailloom.streaming import plans

    rng = random.Random(5)
    schema = "plan_id string, step_index int, type string, status string, artifacts array<string>"
    rows, want = [], {}
    for plan in "abcdef":
        steps = list(range(rng.randint(1, 6)))
        done = {k: [f"{plan}{k}{i}" for i in range(rng.randint(0, 2))] for k in steps if rng.random() < 0.6}
        twice = [k for k in done if rng.random() < 0.4]
        rows += [(plan, k, f"t{k}", "pending", None) for k in steps] + [(plan, k, None, None, v) for k, v in done.items()]
        rows += [(plan, k, None, None, done[k]) for k in twice]
        left = [k for k in steps if k not in done]
        head = (left[0], f"t{left[0]}", "dispatch_execution_plan_step") if left else (None, None, "shutdown")
        want[plan] = (*head, len(done), [a for k in sorted(done) for a in done[k]], sorted(twice), [])
    rows += [("z", 4, None, None, ["late"]), (None, 1, "t", "pending", None), ("z", None, "t", "pending", None)]
    want["z"] = (None, None, "shutdown", 0, ["late"], [], [4])
    rng.shuffle(rows)
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for at in range(0, len(rows), len(rows) // 3 + 1):
        spark.createDataFrame(rows[at : at + len(rows) // 3 + 1], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        streams.write_stream(plans.advance(stream), out, check).awaitTermination()
    got = {r[0]: tuple(r)[1:] for r in plans.standing(spark.read.parquet(out)).collect()}
    assert got == want


def test_resume_keeps_keyed_state(spark, tmp_path):
    """The join is the engine's own, over state without a limit; nothing is written but pairs and checkpoint."""
    schema = "thread_id string, message_id string, type string, ts timestamp"
    spark.createDataFrame([("t", "q", "new_request"), ("t", "r", "hitl_response"), (None, "x", "new_request")], "thread_id string, message_id string, type string").withColumn(
        "ts", F.timestamp_seconds(F.lit(5))
    ).write.parquet(str(tmp_path / "in"))
    query = streams.resume_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    (operator,) = query.recentProgress[0].stateOperators
    assert operator.operatorName == "symmetricHashJoin" and operator.numRowsTotal == 2
    assert "RocksDB" in str(operator.customMetrics) or "rocksdb" in str(operator.customMetrics)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["check", "in", "out"]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_stored_points_are_not_moved(spark, tmp_path):
    """Read with a join by id and upsert: an exchange for the new rows only."""
    table = PointTable(spark, str(tmp_path / "points"), buckets=4)
    table.upsert(vector_points(spark, [(f"p{k}", f"m{k}", "x", [1.0]) for k in range(40)]))
    vector_points(spark, [(f"p{k}", f"m{k}", "y", [2.0]) for k in range(30, 50)]).write.parquet(str(tmp_path / "new"))
    new = spark.read.parquet(str(tmp_path / "new"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for joined in (upsert.merge_points(table.read(), new), table.read().join(new.select("id"), "id")):
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning(id") == 1 and "Bucketed: true" in plan, plan
        merged = {r["id"]: r["payload"]["chunk_text"] for r in upsert.merge_points(table.read(), new).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert merged == {f"p{k}": "x" if k < 30 else "y" for k in range(50)}


def test_failed_upsert_leaves_the_old_points(spark, tmp_path, monkeypatch):
    table = PointTable(spark, str(tmp_path / "points"))
    table.upsert(vector_points(spark, [("a", "m", "a", [1.0]), ("b", "m", "b", [1.0])]))
    monkeypatch.setattr(table, "_store", lambda name, value: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.upsert(vector_points(spark, [("c", "m", "c", [1.0])]), replace_emails=True)
    assert sorted(r["id"] for r in PointTable(spark, table.path).read().collect()) == ["a", "b"]


def test_position_index(spark, tmp_path):
    """Pages and numbers equal the sorted list; only keys are written, and a page reads few ranges."""
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(40)]), k, "wide" * 5) for k in range(500)]
    spark.createDataFrame(rows, "a int, b int, body string").repartition(5).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    index = ordering.PositionIndex.build(df, str(tmp_path / "index"), "a", "b")
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    for limit, offset in ((10, 0), (25, 240), (7, 496), (5, 900), (500, 0), (3, 12)):
        got = sorted((tuple(r) for r in index.page(df, limit, offset).collect()), key=key)
        assert got == want[offset : offset + limit]
    numbered = {(r["a"], r["b"]): r["row_index"] for r in index.number(df).collect()}
    assert numbered == {r[:2]: k for k, r in enumerate(want)} and index.count() == 500
    unique = {(r["a"], r["b"]): r["row_index"] for r in ordering.with_row_index(df, "a", "b", unique=True).collect()}
    assert unique == numbered
    assert set(index._keys().columns) == {"a", "b", "__part", "__local"}
    plan = index.keys_between(240, 250)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__part" in plan, plan


def test_numbering_writes_no_wide_column(spark, tmp_path):
    emails(spark, range(50)).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    written = []
    before = ordering.settled
    ordering.settled = lambda d: written.append(d.columns) or before(d)
    try:
        numbered = ordering.with_row_index(df, "arrival", unique=True)
        assert [r["row_index"] for r in numbered.orderBy("arrival").collect()] == list(range(50))
    finally:
        ordering.settled = before
    assert written == [["arrival", "__part", "__local"]]


def test_redelivered_messages_are_dropped_by_state(spark, tmp_path):
    """Copies in a later batch never reach the sink; other content under the same id does."""
    folder, schema = str(tmp_path / "in"), "arrival long, id string, threadId string, raw string"
    feed = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        raw = spark.readStream.schema(schema).parquet(folder)
        query = streams.write_stream(streams.without_redelivered(raw, "1 day"), out, check)
        query.awaitTermination()
        return query

    feed([(1, "m1", "t", "aaa"), (2, "m2", "t", "bbb"), (3, "m2", "t", "bbb")])
    query = run()
    assert [o.operatorName for o in query.recentProgress[0].stateOperators] == ["dedupeWithinWatermark"]
    feed([(4, "m1", "t", "aaa"), (5, "m1", "t", "other"), (6, "m3", "t", "ccc")])
    run()
    got = sorted((r["id"], r["raw"]) for r in spark.read.schema(schema).parquet(out).collect())
    assert got == [("m1", "aaa"), ("m1", "other"), ("m2", "bbb"), ("m3", "ccc")]


def test_counters_of_streams(spark, tmp_path):
    from mailloom.operators.embedding import hashing_encoder
    from mailloom.streaming.counters import stream_counters

    folder = str(tmp_path / "in")
    rows = emails(spark, range(30), body="a  b ").withColumn("body_cleaned", F.when(F.col("arrival") % 3 == 0, "a b").otherwise("a  b "))
    rows.repartition(3).write.parquet(folder)
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    points_ = PointTable(spark, str(tmp_path / "points"), buckets=2)
    with stream_counters(spark) as counters:
        cleaned = streams.clean_stream(stream(), str(tmp_path / "out"), str(tmp_path / "c1"))
        assert counters.of(cleaned) == {"processed": 30, "updated": 20}
        vectorized = streams.vectorize_stream(stream(), points_, hashing_encoder(8), str(tmp_path / "c2"))
        assert counters.of(vectorized) == {"emails_processed": 30, "chunks_upserted": 30}
    assert points_.read().count() == 30


def test_repeated_import_batch(spark, tmp_path):
    """A batch whose commit was lost is run again: nothing is inserted or rejected twice, and files are merged."""
    folder, schema = str(tmp_path / "in"), "arrival long, id string, threadId string, raw string"
    good, bad = "RnJvbTogYUBiLmMKCmhp", "!"
    table = EmailTable(spark, str(tmp_path / "emails"), digits=1)
    feed = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    def run():
        raw = spark.readStream.schema(schema).parquet(folder)
        streams.import_stream(raw, table, str(tmp_path / "check"), compact_every=2).awaitTermination()

    feed((1, "m1", "t", good), (2, "x", "t", bad))
    run()
    (tmp_path / "check" / "commits" / "0").unlink()
    (tmp_path / "check" / "commits" / ".0.crc").unlink(missing_ok=True)
    run()
    assert table.read().count() == 1 and [r["external_message_id"] for r in table.rejected().collect()] == ["x"]
    feed((3, "m2", "t", good), (4, "y", "t", bad))
    run()
    assert table.read().count() == 2 and sorted(r["external_message_id"] for r in table.rejected().collect()) == ["x", "y"]


def test_plan_state_is_read_and_written_once():
    """However many rows a micro-batch brings for a plan, the engine is called twice for its state."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    from mailloom.streaming.plans import PlanProgress

    kept, calls = [None], []
    state = SimpleNamespace(get=lambda: calls.append("get") or kept[0], update=lambda v: calls.append("update") or kept.__setitem__(0, v))
    progress = PlanProgress()
    progress.init(SimpleNamespace(getValueState=lambda *_: state))
    row = lambda step, artifacts: Row(step_index=step, type=f"t{step}", status="pending", artifacts=artifacts)
    list(progress.handleInputRows(("p",), iter([row(k, None) for k in range(20)] + [row(3, ["a"]), row(3, ["b"])]), None))
    (last,) = progress.handleInputRows(("p",), iter([row(0, []), row(0, None)]), None)
    assert calls == ["get", "update"] * 2
    assert (last.version, last.step_index, last.type, last.completed, last.artifacts, last.repeated) == (2, 1, "t1", 2, ["a"], [3])
