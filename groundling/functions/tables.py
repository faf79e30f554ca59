"""Word lists, rules, patterns and limits that results depend on. Kept as plain text, in their order."""

# ---- fixed values: routing
GITHUB_URL = r"^(?:https?://)?(?:www\.)?github\.com/([^/]+)(?:/([^/]+))?(?:/(blob|tree|pull|issues|releases|raw)/(.+))?/?$"
ARXIV_ID = r"^\d{4}\.\d{4,5}(v\d+)?$"
ARXIV_URL = r"arxiv\.org/(?:abs|pdf|html)/([\d.]+)"
DOMAIN_LIKE = r"^[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
AUTH_KINDS = ("github_pr", "github_org", "github_blob")
REPO_KINDS = ("github_repo", "github_blob", "github_pr", "github_org")
PAPER_KINDS = ("arxiv", "pdf")

# ---- fixed values: crawling
NO_FOLLOW = ".png .jpg .jpeg .gif .svg .webp .ico .pdf .zip .tar .gz .mp4 .mp3 .woff .woff2 .ttf .css .js .json .xml".split()
CRAWL_PREFIXES = "/docs /documentation /guide /guides /api /manual /reference /help".split()
DOCS_PATHS = "/docs /documentation /guide /reference /manual /api/".split()
DOCS_HOSTS = "docs. gitbook.io readthedocs developer. developers.".split()
MANIFEST_URL = r"https?://[^\s\]\)>\"'<`]+"

# ---- fixed values: repository files
SKIP_DIRS = ".git node_modules __pycache__ .mypy_cache .pytest_cache .ruff_cache venv .venv env dist build target .idea .vscode .eggs .ipynb_checkpoints site-packages".split()
BINARY_EXTS = (
    ".png .jpg .jpeg .gif .webp .bmp .ico .tif .tiff .pdf .zip .gz .tar .tgz .bz2 .xz .7z .rar .mp3 .mp4 .wav .ogg .webm .mov .avi .mkv "
    ".ttf .otf .woff .woff2 .eot .so .dylib .dll .exe .o .a .pyc .pyo .whl .egg .class .jar .onnx .pt .pth .safetensors .bin .npz .npy .h5 .hdf5 .parquet .arrow"
).split()
FILE_PRIORITY = [
    (r"(^|/)README", 0),
    (r"\.md$|\.mdx$|\.rst$", 1),
    (r"(^|/)(setup\.py|pyproject\.toml|package\.json|Cargo\.toml|go\.mod|build\.gradle|pom\.xml)$", 2),
    (r"(^|/)requirements.*\.txt$|(^|/)Pipfile|(^|/)poetry\.lock$", 3),
    (r"(^|/)config|\.toml$|\.yaml$|\.yml$", 4),
    (r"model|architecture|network", 5),
    (r"train|inference|infer|loss|optim", 6),
    (r"(^|/)src/|(^|/)lib/|(^|/)core/|(^|/)main\.|(^|/)index\.", 7),
    (r"\.py$|\.ts$|\.tsx$|\.js$|\.jsx$|\.rs$|\.go$|\.java$|\.kt$", 8),
    (r"(^|/)examples?/|(^|/)demos?/", 10),
    (r"(^|/)docs?/", 11),
    (r"(^|/)tests?/|test_|_test\.|\.test\.|spec_|_spec\.", 90),
]
OTHER_PRIORITY, CAPPED_PRIORITY = 50, 8
SKIP_FILES = [
    r"\.test\.|\.spec\.|_test\.[a-z]+$|test_[a-z_]+\.|__tests__|/tests?/",
    r"\.d\.ts$",
    r"node_modules|__pycache__|/dist/|/build/|/target/|\.next/",
    r"\.min\.(js|css)$",
]
ENTRY_POINTS = (
    "src/index.ts src/index.js src/main.ts src/main.py src/lib.rs src/main.rs src/index.tsx index.ts index.js index.tsx main.py __init__.py main.go lib/index.ts lib/index.js mod.rs lib.rs"
).split()
MANIFESTS = "package.json pyproject.toml Cargo.toml go.mod tsconfig.json requirements.txt Pipfile Anchor.toml foundry.toml".split()
LANGUAGES = {
    "typescript": [".ts", ".tsx", ".mts", ".cts"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "python": [".py", ".pyi"],
    "rust": [".rs"],
    "go": [".go"],
    "java": [".java"],
    "kotlin": [".kt", ".kts"],
    "csharp": [".cs"],
    "ruby": [".rb"],
    "swift": [".swift"],
}
SIGNATURES = {
    "typescript": r"^\s*(export\s|declare\s)",
    "javascript": r"^\s*(export\s|module\.exports|exports\.)",
    "python": r"^(async\s+def|def|class)\s",
    "rust": r"^\s*pub\s+(fn|struct|enum|trait|mod|type|const|static)\s",
    "go": r"^(func|type|var|const)\s",
    "java": r"^\s*(public|private|protected)\s",
    "kotlin": r"^\s*(class|interface|object|fun|val|var)\s",
    "csharp": r"^\s*(public|private|protected|internal)\s",
    "ruby": r"^\s*(class|module|def)\s",
    "swift": r"^\s*(public|open|internal|class|struct|enum|protocol|func|var|let)\s",
}

# ---- fixed values: html
NAMED_ENTITIES = [
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&mdash;", "—"),
    ("&ndash;", "–"), ("&hellip;", "…"), ("&rsquo;", "'"), ("&lsquo;", "'"), ("&rdquo;", '"'), ("&ldquo;", '"'),
]
STRUCTURAL_TAG = r"(?i)<(?:html|head|body|div|script|style|svg|article|section|aside|nav|header|footer|main|p\b|h[1-6]\b|table|ul|ol|li)\b"
MARKDOWN_DROPPED_TAGS = "script style noscript iframe svg nav footer aside".split()
MARKDOWN_DROPPED_NAMES = "sidebar side-bar navbar nav-bar toc table-of-contents site-footer breadcrumbs cookie consent".split()

# ---- fixed values: claims
CODE = r"`([^`\n]{2,80})`"
URL = r"(?i)\bhttps?://[^\s)\]\}\"]+"
PATH = r"\b[A-Za-z0-9_.-]+/[A-Za-z0-9_./\-]{2,}"
QUOTED = r'"([^"\n]{3,80})"'
SINGLE_QUOTED = r"'([^'\n]{3,80})'"
NUMBER = r"(?<![\w.])(\d+(?:\.\d+)?(?:[eE][-+]?\d+)?(?:%|[a-zA-Z]{1,4})?)(?![\w.])"
IDENTIFIER = (
    r"\b([a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9_]+|[a-zA-Z][a-zA-Z0-9]*_[a-zA-Z0-9_]+|[A-Z][a-z]+(?:[A-Z][a-z]+){1,}|[A-Z]{2,}[A-Z0-9_]+"
    r"|[A-Za-z]+(?:\.[A-Za-z][A-Za-z0-9_]+){1,}|[A-Za-z]{2,}\d+[A-Za-z0-9]*)\b"
)
INLINE_IDENTIFIER = r"`([A-Za-z_][A-Za-z0-9_.()/\[\]:-]{3,80})`"
TRAILING_MARKS = ".,;)]}>"
ACRONYMS = (
    "Adam AdamW SGD RMSprop Adagrad LARS LAMB ReLU GELU SiLU ELU SELU Tanh Sigmoid Softmax BERT GPT T5 BART XLNet RoBERTa ViT CLIP LoRA QLoRA "
    "RNN LSTM GRU CNN MLP GAN VAE NeRF DDPM DDIM PPO DPO RLHF TRPO SAC DQN A2C A3C KL MSE CE BCE "
    "CUDA ROCm NVCC cuDNN NCCL HBM SRAM DRAM TPU GPU CPU FPGA ASIC AVX SIMD SSE SSE2 ARM x86 RISCV "
    "HTTP HTTPS REST gRPC GraphQL WebSocket WebRTC JSON YAML TOML XML HTML CSS SVG CSV TSV Parquet Avro "
    "JWT OAuth OIDC SAML SSO TLS SSL mTLS DNS BGP NAT CDN TCP UDP ICMP FTP SFTP SMTP IMAP POP3 SSH "
    "SHA MD5 HMAC AES RSA ECDSA Ed25519 Curve25519 X25519 Schnorr EVM SVM ABI BIP ERC EIP TPS UTXO DeFi NFT DAO ZKP SNARK STARK USDC USDT ETH BTC SOL MATIC "
    "CLI SDK API UI UX IaC CI CD SLA SLO SRE P99 P95 P50 AWS GCP Azure S3 EC2 RDS ECS EKS GKE AKS K8s KMS IAM WASM WASI JVM CLR FFI IPC RPC MCP "
    "SQL NoSQL ORM CRUD ACID CAP CRDT WAL MVCC FLOPs FLOPS BPE WPM BLEU ROUGE METEOR CER WER mAP IoU"
).split()
STOPWORDS = (
    "true false none null this that with from into over the and or not but for you your our its their use using used when where while after before then "
    "yes no unknown unclear specified source page section see also note example examples other various more most many some few like such etc via along through across "
    "include includes including required optional default custom"
).split()
TRIVIAL_NUMBERS = "0 1 2 3 4 5 6 7 8 9 10 100 1000".split()
YAML_SKIPPED = r"(?i)^(name|id|version|category|author|date):\s"
TOP_SECTION, UNNAMED_SECTION = "(top)", "(unnamed)"

# ---- fixed values: guard
DANGEROUS_SECTIONS = [
    r"\bAPIs?\b", r"\bFunctions?\b", r"\bClasses?\b", r"\bMethods?\b", r"\bEndpoints?\b", r"\bConfig(uration)?\b", r"\bInterfaces?\b", r"\bTypes?\b",
    r"\bSchema(s|tic)?\b", r"\bSignatures?\b", r"\bArchitecture\b", r"\bComponents?\b", r"\bSDK\b", r"\bUsage\b", r"\bRPC\b", r"\bGraphQL\b", r"\bREST\b",
    r"\bIntegration\b", r"\bImplementation\b", r"\bAPI Reference\b", r"\bModule\b", r"\bStaking\b", r"\bPayment[s]?\b", r"\bIntent\b", r"\bCommand\b",
    r"\bDiscovery\b", r"\bEscrow\b", r"\bTrigger", r"\bMapping\b",
]
GUARDED_KINDS = ("github_repo", "github_blob", "github_pr", "web", "llms_manifest", "text", "arxiv", "pdf")
REPO_EXTRACTED_KINDS = ("github_repo", "github_blob", "github_pr")
DIRECTIVE_MARKER = "<!-- VERBATIM-DIRECTIVE-V1 -->"

# ---- fixed values: truncation
PAPER_KEYWORDS = ["Method", "Methods", "Algorithm", "Architecture", "Equation", "We propose", "Implementation"]
FILES_HEADING = "\n## File contents (priority-ordered)\n"
