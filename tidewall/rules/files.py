"""File types, threat tokens, archive limits and compliance presets."""

from __future__ import annotations

# --- fixed values: file signatures in registry order: (extension, signature in hex, handler) ---
SIGNATURES = (
    ("pdf", "25504446", "builtin-pdf-strategy"),
    ("docx", "504B0304", "office-cdr"),
    ("xlsx", "504B0304", "office-cdr"),
    ("pptx", "504B0304", "office-cdr"),
    ("doc", "D0CF11E0", "office-cdr"),
    ("xls", "D0CF11E0", "office-cdr"),
    ("jtd", "D0CF11E0", "jtd-sanitizer"),
    ("dwg", "41433130", ""),
    ("jpeg", "FFD8FF", ""),
    ("jpg", "FFD8FF", ""),
    ("png", "89504E470D0A1A0A", ""),
    ("gif", "47494638", ""),
    ("tiff", "49492A00", ""),
    ("tif", "4D4D002A", ""),
    ("bmp", "424D", ""),
    ("zip", "504B0304", "zip-scanner"),
    ("rar", "526172211A07", ""),
    ("7z", "377ABCAF271C", ""),
    ("txt", "", ""),
    ("csv", "", ""),
    ("xml", "3C3F786D6C", ""),
    ("exe", "4D5A", ""),
    ("msi", "D0CF11E0", ""),
    ("rtf", "7B5C727466", "office-cdr"),
    ("odt", "504B0304", "office-cdr"),
    ("ods", "504B0304", "office-cdr"),
    ("odp", "504B0304", "office-cdr"),
    ("hwp", "48575020", "office-cdr"),
    ("epub", "504B0304", "zip-scanner"),
    ("fb2", "3C3F786D6C", ""),
    ("xps", "504B0304", "zip-scanner"),
    ("oxps", "504B0304", "zip-scanner"),
    ("md", "", ""),
    ("log", "", ""),
    ("ico", "00000100", "image-metadata-sanitizer"),
    ("icns", "69636E73", "image-metadata-sanitizer"),
    ("heic", "66747970", "image-metadata-sanitizer"),
    ("heif", "66747970", "image-metadata-sanitizer"),
    ("svg", "3C737667", "svg-sanitizer"),
    ("avif", "0000001866797061", "image-metadata-sanitizer"),
    ("webp", "52494646", "image-metadata-sanitizer"),
    ("tar", "7573746172", "zip-scanner"),
    ("gz", "1F8B08", "zip-scanner"),
    ("bz2", "425A68", "zip-scanner"),
    ("xz", "FD377A585E00", "zip-scanner"),
    ("iso", "4344303031", ""),
    ("dmg", "78DA", ""),
    ("squashfs", "73717368", ""),
    ("mp4", "66747970", "media-metadata-sanitizer"),
    ("m4a", "66747970", "media-metadata-sanitizer"),
    ("mov", "66747970", "media-metadata-sanitizer"),
    ("mkv", "1A45DFA3", "media-metadata-sanitizer"),
    ("mp3", "FFFB", "media-metadata-sanitizer"),
    ("flac", "664C6143", "media-metadata-sanitizer"),
    ("avi", "52494646", ""),
    ("wav", "52494646", ""),
    ("ogg", "4F676753", ""),
    ("flv", "464C5601", ""),
    ("mp3", "494433", "media-metadata-sanitizer"),
    ("js", "", ""),
    ("mjs", "", ""),
    ("cjs", "", ""),
    ("ts", "", ""),
    ("tsx", "", ""),
    ("jsx", "", ""),
    ("py", "", ""),
    ("pyw", "", ""),
    ("sh", "", ""),
    ("bash", "", ""),
    ("zsh", "", ""),
    ("ps1", "", ""),
    ("bat", "", ""),
    ("cmd", "", ""),
    ("vbs", "", ""),
    ("vbe", "", ""),
    ("htm", "", "html-sanitizer"),
    ("html", "", "html-sanitizer"),
    ("dll", "4D5A", ""),
    ("elf", "7F454C46", ""),
    ("mach-o", "FEEDFACE", ""),
    ("mach-o", "CEFAEDFE", ""),
    ("mach-o", "CAFEBABE", ""),
    ("class", "CAFEBABE", ""),
)

MIME_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "doc": "application/msword",
    "xls": "application/vnd.ms-excel",
    "jtd": "application/x-ichitaro",
    "rtf": "application/rtf",
    "odt": "application/vnd.oasis.opendocument.text",
    "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "odp": "application/vnd.oasis.opendocument.presentation",
    "hwp": "application/x-hwp",
    "epub": "application/epub+zip",
    "fb2": "application/x-fictionbook+xml",
    "xps": "application/vnd.ms-xpsdocument",
    "oxps": "application/oxps",
    "jpeg": "image/jpeg", "jpg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "tiff": "image/tiff", "tif": "image/tiff",
    "bmp": "image/bmp",
    "ico": "image/x-icon",
    "icns": "image/icns",
    "heic": "image/heic", "heif": "image/heic",
    "svg": "image/svg+xml",
    "avif": "image/avif",
    "webp": "image/webp",
    "zip": "application/zip",
    "rar": "application/vnd.rar",
    "7z": "application/x-7z-compressed",
    "tar": "application/x-tar",
    "gz": "application/gzip",
    "bz2": "application/x-bzip2",
    "xz": "application/x-xz",
    "iso": "application/x-iso9660-image",
    "dmg": "application/x-apple-diskimage",
    "squashfs": "application/vnd.squashfs",
    "txt": "text/plain",
    "csv": "text/csv",
    "xml": "application/xml",
    "md": "text/markdown",
    "log": "text/plain",
    "mp4": "video/mp4",
    "m4a": "audio/mp4",
    "mov": "video/quicktime",
    "mkv": "video/x-matroska",
    "mp3": "audio/mpeg",
    "flac": "audio/flac",
    "avi": "video/x-msvideo",
    "wav": "audio/wav",
    "ogg": "audio/ogg",
    "flv": "video/x-flv",
    "js": "application/javascript", "mjs": "application/javascript", "cjs": "application/javascript",
    "ts": "application/typescript",
    "tsx": "text/jsx", "jsx": "text/jsx",
    "py": "text/x-python", "pyw": "text/x-python",
    "sh": "application/x-sh", "bash": "application/x-sh", "zsh": "application/x-sh",
    "ps1": "application/x-powershell",
    "bat": "application/x-msdos-program", "cmd": "application/x-msdos-program",
    "vbs": "application/vbscript", "vbe": "application/vbscript",
    "htm": "text/html", "html": "text/html",
    "exe": "application/vnd.microsoft.portable-executable",
    "dll": "application/vnd.microsoft.portable-executable",
    "msi": "application/x-msi",
    "elf": "application/x-elf",
    "mach-o": "application/x-mach-binary",
    "class": "application/java-vm",
    "dwg": "application/dwg",
}

# active content in markup
DANGEROUS_ELEMENTS = {"script": "script_element", "foreignobject": "foreign_object", "handler": "script_element"}
ANIMATIONS = ("animate", "animatetransform", "animatemotion")
ANIMATION_TRIGGERS = ("click", "load", "mouseover", "focus")
SCRIPT_DATA_TYPES = ("data:text/javascript", "data:application/javascript", "data:text/ecmascript")
STYLE_THREATS = ("expression(", "-moz-binding", "url(javascript:", "behavior(")
EVENT_HANDLERS = (
    "onclick", "ondblclick", "onmousedown", "onmouseup", "onmouseover", "onmousemove", "onmouseout",
    "onmouseenter", "onmouseleave",
    "onkeydown", "onkeyup", "onkeypress",
    "onfocus", "onblur", "onfocusin", "onfocusout", "onsubmit", "onreset", "onchange", "oninput", "onselect",
    "onload", "onunload", "onbeforeunload", "onabort", "onerror", "onresize", "onscroll",
    "ondrag", "ondragstart", "ondragend", "ondragenter", "ondragleave", "ondragover", "ondrop",
    "oncopy", "oncut", "onpaste",
    "ontouchstart", "ontouchmove", "ontouchend", "ontouchcancel",
    "onpointerdown", "onpointerup", "onpointermove", "onpointerover", "onpointerout", "onpointerenter",
    "onpointerleave", "onpointercancel",
    "onbegin", "onend", "onrepeat",
    "onplay", "onpause", "onplaying", "onended", "ontimeupdate", "onvolumechange", "onseeking", "onseeked",
    "oncontextmenu", "onwheel", "onanimationstart", "onanimationend", "onanimationiteration", "ontransitionend",
)

# active content tokens of page-description files
DOCUMENT_TOKENS = (
    ("javascript", r"/JS[ \t]*(?:\([^)]*\)|<[0-9A-Fa-f]+>)"),
    ("javascript_long", r"/JavaScript[ \t]*(?:\([^)]*\)|<[0-9A-Fa-f]+>)"),
    ("additional_actions", r"/AA[ \t]*<<"),
    ("open_action", r"/OpenAction"),
    ("acro_form", r"/AcroForm"),
    ("submit_form", r"/S[ \t]*/SubmitForm"),
    ("uri_action", r"/URI[ \t]*(?:\(https?://[^)]*\)|<https?://[^>]*>)"),
    ("embedded_file", r"/EmbeddedFile"),
    ("rich_media", r"/RichMedia"),
)
MAX_DOCUMENT_BYTES = 500 * 1024 * 1024

# script, DDE and protocol patterns in cell or page text: (kind, name, regex, literal every hit contains)
SCRIPT_PATTERNS = (
    ("dde", "=CMD|", r"(?i)=CMD\|", "=cmd|"),
    ("dde", "=EXEC(", r"(?i)=EXEC\(", "=exec("),
    ("dde", "=MSQUERY", r"(?i)=MSQUERY", "=msquery"),
    ("protocol", "file://", r"(?i)file://", "file://"),
    ("protocol", "javascript:", r"(?i)javascript:", "javascript:"),
    ("protocol", "vbscript:", r"(?i)vbscript:", "vbscript:"),
    ("protocol", "data:", r"(?i)data:", "data:"),
    ("script", "powershell", r"(?i)powershell", "powershell"),
    ("script", "cmd.exe", r"(?i)cmd\.exe", "cmd.exe"),
    ("script", "cmd /c", r"(?i)cmd /c", "cmd /c"),
    ("script", "cmd /k", r"(?i)cmd /k", "cmd /k"),
    ("script", "vbscript:", r"(?i)vbscript:", "vbscript:"),
    ("script", "jscript:", r"(?i)jscript:", "jscript:"),
    ("script", "wscript.shell", r"(?i)wscript\.shell", "wscript.shell"),
    ("script", "shell.execute", r"(?i)shell\.execute", "shell.execute"),
    ("script", "eval(", r"(?i)eval\s*\(", "eval"),
    ("script", "document.write", r"(?i)document\.write", "document.write"),
)

DANGEROUS_PARTS = ("vbaProject.bin", "vbaData.xml", "activeX", "oleObject")
DANGEROUS_CONTENT_TYPES = (
    "application/vnd.ms-office.vbaProject",
    "application/vnd.ms-office.activeX",
    "application/vnd.ms-office.activeX+xml",
    "application/vnd.ms-office.oleObject",
    "application/vnd.ms-office.oleObject+xml",
    "application/xml",
)

ARCHIVE_MAX_DEPTH = 5
ARCHIVE_MAX_RATIO = 10
ARCHIVE_MAX_ENTRY_BYTES = 100 * 1024 * 1024
ARCHIVE_MAX_TOTAL_BYTES = 1024 * 1024 * 1024
ALLOWED_ENTRY_EXTENSIONS = (
    "pdf", "docx", "xlsx", "pptx", "odt", "ods", "odp", "rtf", "jpeg", "jpg", "png", "gif", "tiff", "tif",
    "bmp", "svg", "csv", "txt", "xml", "htm", "html",
)
BLOCKED_EXECUTABLES = (
    "exe", "scr", "bat", "cmd", "ps1", "vbs", "js", "msi", "com", "pif", "hta", "wsf", "cpl",
)

PPAP_THRESHOLD = 0.7
PPAP_CONTAINERS = ("zip", "lzh", "7z")
# the last two are written without nested repeats, which a backtracking engine would blow up on
PPAP_NAME_PATTERNS = (
    r"(?i)(機密|重要|秘|内覧|非公開|限|別紙|添付|御中)",
    r"\d{8}.*\.(zip|lzh|7z)$",
    r"(?i)第\d+回.*\.(zip|lzh|7z)$",
    r"(?i)(提出|送付|参考|照会).*\.(zip|lzh|7z)$",
)

DOWNGRADES = {"xlsm": "xlsx", "docm": "docx", "pptm": "pptx", "xlsb": "xlsx"}
SEVERITY_LEVEL = {"info": 1, "low": 2, "medium": 3, "high": 4, "critical": 5}

# name, approval, reason, policy, depth, ratio, pdf MB, office MB, zip MB, audit days, log ip, log agent
PRESETS = (
    ("lgwan_government", True, True, "strip_active_content", 2, 5, 100, 50, 200, 2555, True, True),
    ("medical_hipaa_jp", True, True, "convert_to_flat", 1, 3, 50, 25, 100, 3650, True, True),
    ("sler_general", False, False, "strip_active_content", 3, 10, 500, 200, 500, 365, False, False),
    ("nist_zta", True, True, "convert_to_flat", 1, 3, 50, 25, 100, 2555, True, True),
    ("acsc_au", True, False, "strip_active_content", 3, 10, 200, 100, 500, 2555, True, False),
    ("fss_kr", True, True, "strip_active_content", 2, 5, 100, 50, 200, 3650, True, True),
    ("digital_agency_zt", True, True, "convert_to_flat", 1, 3, 50, 25, 100, 2555, True, True),
)
# --- end of fixed values ---

PRESET_SCHEMA = (
    "name string, approval_required boolean, reason_required boolean, sanitization_policy string,"
    " zip_max_depth bigint, zip_max_ratio bigint, max_pdf_mb bigint, max_office_mb bigint, max_zip_mb bigint,"
    " audit_retention_days bigint, log_ip boolean, log_agent boolean"
)
