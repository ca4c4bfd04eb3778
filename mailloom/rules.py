"""Fixed values that decide results: lists, patterns, limits and constants."""

# Tags whose whole content is dropped.
GARBAGE_TAGS = [
    "script", "style", "head", "meta", "noscript", "svg", "canvas",
    "iframe", "object", "embed", "footer", "form", "input", "button",
]

# An inline style that contains one of these hides its element.
HIDDEN_STYLES = [
    "display:none", "visibility:hidden", "opacity:0", "font-size:0",
    "max-height:0", "max-width:0", "height:0", "width:0",
    "overflow:hidden", "mso-hide:all",
]

# Tags with a line break on both sides.
BLOCK_TAGS = [
    "p", "div", "section", "article", "li", "tr", "table",
    "h1", "h2", "h3", "h4", "h5", "h6",
]

# HTML elements without content.
VOID_TAGS = [
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed",
    "frame", "hr", "image", "img", "input", "isindex", "keygen", "link",
    "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr",
]

# Space characters written as a plain space.
UNICODE_SPACES = (
    "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
)

# Characters removed at both ends by a strip.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# A line of this form starts a quoted reply chain.
REPLY_HEADERS = [
    r"on .+wrote:",
    r"from:\s.+",
    r"sent:\s.+",
    r"to:\s.+",
    r"subject:\s.+",
    r"-{2,}\s*original message\s*-{2,}",
    r"-{2,}\s*forwarded message\s*-{2,}",
    r"begin forwarded message:",
]

# A lower-cased line that starts like this is leaked markup.
MARKUP_LINES = [
    r"<!doctype",
    r"<html\b",
    r"</html>$",
    r"<body\b",
    r"</body>$",
    r"<head\b",
    r"</head>$",
    r"<meta\b",
    r"<title\b",
    r"</title>$",
    r"xmlns(:\w+)?=",
    r'public "-//w3c//dtd',
    r"http://www\.w3\.org/tr/xhtml1/",
]

# A lower-cased line with one of these anywhere is a footer.
FOOTER_PHRASES = [
    r"unsubscribe",
    r"manage preferences",
    r"email preferences",
    r"update preferences",
    r"privacy policy",
    r"cookie policy",
    r"terms of service",
    r"view in browser",
    r"open in browser",
    r"web version",
    r"all rights reserved",
    r"copyright\s*(©|\(c\))?",
    r"this email was sent to",
    r"you are receiving this email",
    r"add us to your address book",
    r"if you no longer wish to receive",
    r"to stop receiving these emails",
    r"click here to unsubscribe",
    r"do not reply to this email",
    r"please do not reply",
    r"automated message",
    r"this message and any attachments",
    r"confidentiality notice",
    r"virus[- ]free",
    r"environment before printing",
    r"follow us on",
    r"facebook",
    r"instagram",
    r"linkedin",
    r"twitter",
    r"youtube",
]

# A lower-cased line equal to one of these is a footer.
FOOTER_LINES = [
    "unsubscribe", "privacy policy", "view online", "view in browser",
    "manage preferences", "update preferences",
]

# Lines blanked in the last pass.
SIGNATURE_LINES = [
    r"powered by .+",
    r"sent from my .+",
    r"download the app.*",
    r"get the app.*",
    r"<!doctype.*",
    r"<html.*",
    r"</html>",
    r"<body.*",
    r"</body>",
]

# Separator line, image marker line, web address.
SEPARATOR_LINE = r"[-_=~*#]{3,}"
IMAGE_LINE = r"\[image.*\]"
WEB_ADDRESS = r"https?://\S+"

# Repeated lines shorter than this are kept once per text.
SHORT_LINE = 120

# First address in a free-form sender.
EMAIL_ADDRESS = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"

# Chunking.
CHUNK_WORDS = 120
CHUNK_OVERLAP = 30
EMPTY_BODY = "Empty email body"
EMPTY_SUBJECT = "Empty subject"

# Name space of the point ids (RFC 4122, URL).
UUID_URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"

# Column limits of the emails table.
COLUMN_LIMITS = {
    "external_message_id": 255,
    "external_thread_id": 255,
    "subject": 1000,
    "sender": 320,
}

# Batch sizes and list limits.
IMPORT_CHUNK = 100
RECENT_LIMIT = 20
SENDER_LIMIT = 50
THREAD_LIMIT = 100
MAILBOX_LIMIT = 1000
BACKFILL_OVERLAP_DAYS = 1
VECTOR_DIM = 1024

# Event, gate, step and route names.
RESPONSE_MARK = "HITL_RESPONSE"
EVENT_RESPONSE = "hitl_response"
EVENT_REQUEST = "new_request"
SENDER_INTERNAL = "internal"
SENDER_EXTERNAL = "external"
SECURITY_OPEN = ["clean", "suspicious"]
STEP_PENDING = "pending"
STEP_COMPLETED = "completed"
STEP_STATES = [STEP_PENDING, STEP_COMPLETED]
STEP_TYPES = ["perform_local_action", "send_email", "do_nothing"]
CAPABILITIES = ["execute_browser_action", "execute_bash_action"]
ROUTE_PLAN = "build_execution_plan"
ROUTE_DISPATCH = "dispatch_execution_plan_step"
ROUTE_SHUTDOWN = "shutdown"
