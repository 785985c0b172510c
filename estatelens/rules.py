"""Word lists, lookup tables, patterns and formats, as plain text.

These are fixed values: results depend on every entry, so they are stated
here once, in natural order, and used by the operators.
"""

# --- fixed values: closed enumerations in canonical order -------------------

INPUT_CATEGORIES = ["http_request", "scheduled_event", "message_consumed", "file_read", "cli_argument", "other"]
OUTPUT_CATEGORIES = ["http_response", "message_published", "file_written", "database_write", "external_call", "other"]
SERVICE_KINDS = ["http_api", "message_broker", "object_store", "cache", "auth_provider", "other"]
ACCESS_MODES = ["read", "write", "read_write", "unknown"]
SNAPSHOT_STATUSES = ["in_progress", "completed", "failed"]
SNAPSHOT_TRIGGERS = ["full", "single_project", "scheduled", "startup_load"]
CONFLICT_KINDS = ["conflict", "no_conflict", "indeterminate"]

# --- fixed values: limits and messages --------------------------------------

SUMMARY_MAX = 1000
UNKNOWN_SUMMARY = "unknown"
NO_MATERIAL = "insufficient source material"
BRANCH_MISSING = "analysis_branch_missing"
OVERLAP = 0.6
EXCERPT_MAX = 80
UNKNOWN_ACCESS_SUFFIX = " [access: unknown]"
BUILD_SKIP = "build constraint requires toolchain"
CGO_SKIP = "cgo directive requires toolchain"

# --- fixed values: files worth reading --------------------------------------

MANIFEST_NAMES = [
    "Dockerfile", "Gemfile", "build.gradle", "build.gradle.kts", "composer.json", "go.mod", "package.json",
    "pom.xml", "pyproject.toml", "requirements.txt", "setup.cfg", "setup.py", "Cargo.toml",
]
SOURCE_EXTENSIONS = [
    ".go", ".java", ".js", ".jsx", ".kt", ".kts", ".py", ".rb", ".rs", ".sql", ".toml", ".ts", ".tsx", ".yaml",
    ".yml",
]
DOC_EXTENSIONS = [".md", ".markdown", ".rst", ".txt", ".adoc"]

# --- fixed values: files without service evidence ---------------------------

NO_SERVICE_FOLDERS = [
    "node_modules", "vendor", ".git", ".venv", "venv", "env", "dist", "build", "target", "__pycache__", ".tox",
    ".cache", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".idea", ".vscode", "site-packages",
    "bower_components",
]
NO_SERVICE_NAMES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", "Cargo.lock",
    "composer.lock", "go.sum",
]
NO_SERVICE_EXTENSIONS = [
    ".md", ".rst", ".adoc", ".txt", ".min.js", ".bundle.js", ".map", ".lock", ".log", ".svg", ".png", ".jpg",
    ".jpeg", ".gif",
]
NO_SERVICE_PREFIXES = ["license", "changelog", "authors", "contributors"]

# --- fixed values: purpose words --------------------------------------------

STOP_WORDS = [
    "a", "an", "and", "any", "are", "as", "at", "be", "been", "being", "but", "by", "can", "could", "did", "do",
    "does", "for", "from", "had", "has", "have", "he", "her", "hers", "him", "his", "how", "i", "in", "into", "is",
    "it", "its", "may", "me", "might", "mine", "must", "my", "no", "nor", "not", "of", "on", "or", "ought", "our",
    "ours", "out", "over", "shall", "she", "should", "so", "than", "that", "the", "their", "theirs", "them", "they",
    "this", "those", "to", "too", "under", "up", "us", "was", "we", "were", "what", "when", "where", "which",
    "while", "who", "whom", "whose", "why", "will", "with", "within", "without", "would", "you", "your", "yours",
]
OWNER_PHRASES = [
    "controls", "handles", "is responsible for", "is the owner of", "is the source of truth for",
    "is the system of record for", "manages", "owner of", "owns",
]
DELEGATE_PHRASES = [
    "delegates", "does not handle", "does not manage", "does not own", "is not responsible for",
    "is not the owner of", "must not",
]
MARKER_WORDS = ["controls", "delegates", "handles", "manages", "owner", "owns", "responsible"]

# --- fixed values: service schemes, hosts and client libraries --------------

SCHEME_KINDS = {
    "kafka": "message_broker", "amqp": "message_broker", "amqps": "message_broker", "mqtt": "message_broker",
    "mqtts": "message_broker", "nats": "message_broker", "stomp": "message_broker", "redis": "cache",
    "rediss": "cache", "memcache": "cache", "memcached": "cache", "s3": "object_store", "gs": "object_store",
    "minio": "object_store",
}
DENIED_SCHEMES = [
    "git", "ssh", "file", "data", "blob", "javascript", "mailto", "tel", "urn", "ws", "wss", "ftp", "ftps", "smtp",
    "smtps", "ldap", "ldaps", "chrome", "chrome-extension", "about", "view-source",
]
LOCAL_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0", "::1", "[::1]", "[::]"]
KIND_RANK = {
    "message_broker": 0, "object_store": 0, "cache": 0, "auth_provider": 0, "http_api": 1, "other": 2,
}
CLOUD_SERVICES = {
    "s3": ("object_store", "aws-s3"), "sqs": ("message_broker", "aws-sqs"), "sns": ("message_broker", "aws-sns"),
    "kinesis": ("message_broker", "aws-kinesis"), "kafka": ("message_broker", "aws-msk"),
    "cognito-idp": ("auth_provider", "aws-cognito"), "elasticache": ("cache", "aws-elasticache"),
    "secretsmanager": ("other", "aws-secrets-manager"), "ses": ("other", "aws-ses"),
}
URL_PATTERN = (
    r"([a-zA-Z][a-zA-Z0-9+.\-]*)://(?:[^@\s/?#:\"'<>`]+@)?(\[[0-9a-fA-F:]+\]|[a-zA-Z0-9._\-]+)"
    r"(?::\d+)?(?:/[^\s'\"`<>{}\[\]\\,]*)?"
)
CLOUD_PATTERN = r"boto3\s*\.\s*(?:client|resource)\s*\(\s*['\"]([a-z0-9\-]+)['\"]"
CLIENT_PATTERNS = [
    (r"\bKafkaProducer\s*\(", "message_broker", "kafka"),
    (r"\bKafkaConsumer\s*\(", "message_broker", "kafka"),
    (r"\baiokafka\.", "message_broker", "kafka"),
    (r"\bpika\.(?:Blocking)?Connection\b", "message_broker", "rabbitmq"),
    (r"\baio_pika\.", "message_broker", "rabbitmq"),
    (r"\bredis\.Redis\s*\(", "cache", "redis"),
    (r"\bredis\.from_url\s*\(", "cache", "redis"),
    (r"\baioredis\.", "cache", "redis"),
    (r"\bmemcache\.Client\s*\(", "cache", "memcached"),
    (r"\bpymemcache\.", "cache", "memcached"),
    (r"\bminio\.Minio\s*\(", "object_store", "minio"),
    (r"\bgoogle\.cloud\.storage\b", "object_store", "google-cloud-storage"),
    (r"\bAuth0Client\b", "auth_provider", "auth0"),
    (r"\bKeycloakOpenID\b", "auth_provider", "keycloak"),
    (r"\baxios\.create\s*\(", "http_api", "axios-http"),
]

# --- fixed values: table references -----------------------------------------

TABLE_TOKEN = (
    r"(`[^`]+`(?:\.`[^`]+`)?|\"[^\"]+\"(?:\.\"[^\"]+\")?|\[[^\]]+\](?:\.\[[^\]]+\])?"
    r"|'[^']+'(?:\.'[^']+')?|[A-Za-z_][\w$]*(?:\.[A-Za-z_][\w$]*)?)"
)
SQL_WRITES = [
    rf"\bINSERT\s+INTO\s+{TABLE_TOKEN}",
    rf"\bUPDATE\s+{TABLE_TOKEN}\s+SET\b",
    rf"\bDELETE\s+FROM\s+{TABLE_TOKEN}",
    rf"\bCREATE\s+(?:TEMPORARY\s+|TEMP\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{TABLE_TOKEN}",
    rf"\bMERGE\s+INTO\s+{TABLE_TOKEN}",
]
SQL_READS = [rf"\bFROM\s+{TABLE_TOKEN}", rf"\bJOIN\s+{TABLE_TOKEN}"]
QUOTED_NAME = r"(\"[^\"]+\"|'[^']+')"
MIGRATIONS = [
    rf"\bop\.create_table\s*\(\s*{QUOTED_NAME}",
    rf"\bop\.drop_table\s*\(\s*{QUOTED_NAME}",
    rf"\bop\.alter_table\s*\(\s*{QUOTED_NAME}",
    rf"\bop\.rename_table\s*\(\s*{QUOTED_NAME}\s*,\s*{QUOTED_NAME}",
]
CLASS_PATTERN = r"^([ \t]*)class\s+(\w+)\b"
MODEL_PATTERNS = [
    r"\b__tablename__\s*=\s*([\"'])([^\"']+)\1",
    r"\bdb_table\s*=\s*([\"'])([^\"']+)\1",
    r"\bself\.table_name\s*=\s*([\"'])([^\"']+)\1",
]
MODEL_QUERIES = [
    (r"\b(\w+)\.query\b", "read"),
    (r"\bsession\.query\(\s*(\w+)\b", "read"),
    (r"\bselect\(\s*(\w+)\b", "read"),
    (r"\bsession\.add\(\s*(\w+)\s*\(", "write"),
]
MODEL_OBJECTS = r"\b(\w+)\.objects\.(\w+)"
OBJECT_READS = [
    "aggregate", "all", "annotate", "count", "distinct", "earliest", "exclude", "exists", "filter", "first", "get",
    "in_bulk", "last", "latest", "none", "order_by", "prefetch_related", "raw", "select_related", "values",
    "values_list",
]
OBJECT_WRITES = [
    "bulk_create", "bulk_update", "create", "delete", "get_or_create", "update", "update_or_create",
]

# --- fixed values: Go repositories ------------------------------------------

GO_CONFIG = "config/config.go"
GO_HELPERS = ["internal/helper.go", "internal/helper/helper.go"]
GO_APM_PREFIX = "go.elastic.co/apm/"
GO_URL = r"\b(https?|tcp|stomp|amqp|redis|grpc)://([^\s\"'`)]+)"
GO_NAMED_URL = r"([A-Za-z_][\w]*?(?:_URL|_ENDPOINT|_BROKER|_HOST|_URI))\s*[:=]+\s*\"([^\"\n]*)\""
GO_DESTINATION = r"([A-Za-z_][\w]*?(?:Destination|Queue|Topic|Subscriber)[\w]*)\s*[:=]+\s*\"([^\"\n]+)\""
GO_SCHEME_KINDS = {
    "tcp": "message_broker", "stomp": "message_broker", "amqp": "message_broker", "redis": "cache",
    "http": "http_api", "https": "http_api",
}
BROKER_METHODS = ["NewSubscriber", "NewSender", "NewClient"]
BROKER_LIBRARIES = ["activemq", "stomp"]
GO_LITERAL = r'"(?:[^"\\\n]|\\[\s\S])*+"|`[^`]*`'
GO_SKIPPED_PHRASE = "Automatically close issues from merge requests"
GO_FORMAT_SCHEMA = r"%[-+#0 ]?\[?\d*\]?[a-zA-Z]+\.(?=[A-Za-z_])"
GO_PROCEDURE = r"\s+([A-Z_][A-Z0-9_]*(?:\.[A-Z_][A-Z0-9_]*)?)\s*\("
TABLE_STOP_WORDS = [
    "all", "and", "any", "as", "asc", "between", "by", "case", "desc", "distinct", "else", "end", "exists", "false",
    "from", "full", "group", "having", "if", "in", "inner", "into", "is", "join", "left", "like", "merge", "not",
    "null", "on", "or", "order", "outer", "right", "select", "set", "table", "then", "true", "union", "update",
    "using", "values", "when", "where", "begin", "cursor", "declare", "dual", "exception", "loop", "package",
    "procedure", "raise", "rowtype", "type", "authorize", "cache", "db", "fx", "pool", "redis",
    "requestoridentifier", "ruleids", "sp", "sysobj",
]
GO_FLAG_NAME_AT = {
    "String": 0, "StringVar": 1, "Int": 0, "IntVar": 1, "Bool": 0, "BoolVar": 1, "Float64": 0, "Float64Var": 1,
    "Duration": 0, "DurationVar": 1, "NewFlagSet": 0,
}
GO_OPEN_WRITES = ["O_WRONLY", "O_RDWR", "O_APPEND", "O_CREATE", "O_TRUNC"]

# --- fixed values: inputs and outputs ---------------------------------------

HTTP_VERBS = ["get", "post", "put", "delete", "patch", "options", "head"]
SCHEDULE_WORDS = ["scheduled_job", "scheduled", "periodic_task", "cron"]
DB_WRITE_METHODS = ["save", "bulk_create", "bulk_update", "bulk_save_objects"]
HTTP_CLIENTS = ["requests", "httpx", "aiohttp", "urllib3"]
BROKER_WORDS = [
    "publisher", "producer", "broker", "topic", "exchange", "channel", "kafka", "rabbit", "sns", "pubsub",
]
SQL_STATEMENT = (
    r"\b(INSERT\s+INTO|UPDATE\s+\w+\s+SET|DELETE\s+FROM|MERGE\s+INTO|REPLACE\s+INTO|UPSERT\s+INTO)\b"
)
JS_EXTENSIONS = [".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs"]
JS_ROUTE = (
    r"\b(?:app|router|server)\s*\.\s*(get|post|put|delete|patch|options|head)\s*\(\s*['\"`]([^'\"`]+)['\"`]"
)
JS_FETCH = r"\bfetch\s*\(\s*['\"`]([^'\"`]+)['\"`]"
JS_AXIOS = r"\baxios\s*\.\s*(get|post|put|delete|patch|head)\s*\(\s*['\"`]([^'\"`]+)['\"`]"
JS_READ = (
    r"\bfs(?:Promises|Promises\.promises)?\s*\.\s*(?:readFile|readFileSync|createReadStream|read)\s*\("
    r"\s*['\"`]([^'\"`]+)['\"`]"
)
JS_WRITE = (
    r"\bfs(?:Promises|Promises\.promises)?\s*\.\s*(?:writeFile|writeFileSync|appendFile|appendFileSync"
    r"|createWriteStream|write)\s*\(\s*['\"`]([^'\"`]+)['\"`]"
)
JS_PUBLISH = r"\b(?:producer|kafkaProducer|publisher)\s*\.\s*(?:send|publish|produce)\s*\("
JS_CONSUME = r"\b(?:consumer|kafkaConsumer|subscription)\s*\.\s*(?:subscribe|run|consume|on)\s*\("
JS_COMMAND = r"\b(?:program|commander|cli)\s*\.\s*command\s*\("
JAVA_MAPPING = (
    r"@(GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping|RequestMapping)"
    r"\s*(?:\(\s*(?:value\s*=\s*|path\s*=\s*)?['\"]?([^,'\"\)]*)['\"]?)?"
)
JAVA_VERBS = {
    "GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE",
    "PatchMapping": "PATCH", "RequestMapping": "ANY",
}
JAVA_SCHEDULED = r"@Scheduled\b"
JAVA_LISTENER = r"@(KafkaListener|RabbitListener|JmsListener|StreamListener)\b"
YAML_CRON = r"^(\s*)(cron|schedule)\s*:\s*['\"]?([^'\"\n#]+?)['\"]?\s*(?:#.*)?$"
