"""Text rules: line patterns over text tables, and structural ones over parsed lines.

A rule set is compiled into one projection: each line is split once, tested by every pattern, and only hits are
exploded. Rules whose globs do not hold a row's path are cut by the same projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.globs import any_glob
from factloom.functions.scalars import ascii_edges

MAX_BYTES = 512 * 1024


@dataclass(frozen=True)
class TextRule:
    id: str
    title: str
    category: str
    severity: str
    pattern: str
    message: str
    globs: tuple[str, ...] = ()
    unless: str | None = None
    opt_in: bool = False
    tags: tuple[str, ...] = ()
    max_bytes: int = MAX_BYTES
    first_only: bool = False
    file_gate: str | None = None
    recommendation: str = ""
    extra: dict = field(default_factory=dict)


IAC = ("**/*.tf", "**/*.tfvars", "**/*.yml", "**/*.yaml", "**/*.json")
KEYS = ("**/*.pem", "**/*.key", "**/*.p12", "**/*.pfx", "**/id_rsa", "**/id_dsa", "**/id_ecdsa", "**/id_ed25519")
WORKFLOWS = (".github/workflows/*.yml", ".github/workflows/*.yaml")
POSTGRES = r"(?i)\b(postgres|postgresql|CONCURRENTLY|jsonb|bigserial|timestamptz|gen_random_uuid)\b"
MIGRATIONS = ("**/migrations/**", "**/migrate/**", "**/*.sql")

#: The line rules, with the patterns that define them.
LINE_RULES = (
    TextRule("no-public-cloud-storage", "Object storage is publicly readable", "Security", "error", r"""(?i)\bacl\s*[:=]\s*["'](public-read|public-read-write)["']|\bAccessControl\s*:\s*["']?(PublicRead|PublicReadWrite)["']?|\b(block_public_acls|block_public_policy|ignore_public_acls|restrict_public_buckets)\s*[:=]\s*false\b|\b(BlockPublicAcls|BlockPublicPolicy|IgnorePublicAcls|RestrictPublicBuckets)\s*:\s*false\b""", "Object storage is open to the public.", IAC, tags=("iac", "storage"), max_bytes=256 * 1024),
    TextRule("no-committed-private-key", "Committed private key", "Security", "error", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", "A private key is committed.", KEYS, first_only=True),
    TextRule("ci-unpinned-action", "Action pinned to a mutable tag or branch", "Security", "warn", r"^\s*(?:-\s*)?uses:\s*['\"]?[\w.-]+/[\w./-]+@\S+", "The action follows a mutable ref.", WORKFLOWS, unless=r"@[0-9a-f]{40,64}\b|\$\{\{", opt_in=True, tags=("ci", "supply-chain"), max_bytes=256 * 1024),
    TextRule("ci-script-injection", "Untrusted context interpolated into a run block", "Security", "error", r"\$\{\{\s*github\.(event\.(issue|pull_request|comment|review|head_commit)[\w.]*(title|body|message|name|email|ref)|head_ref)\b", "Attacker-controlled text reaches a shell.", WORKFLOWS, unless=r"toJSON\(", max_bytes=256 * 1024),
    TextRule("ci-pull-request-target-checkout", "Privileged workflow checks out the proposed code", "Security", "error", r"^\s*ref:\s*['\"]?\$\{\{\s*github\.(event\.pull_request\.head\.(sha|ref)|head_ref)", "Untrusted code runs with the base's secrets.", WORKFLOWS, file_gate=r"(?m)^\s*(on:.*)?\bpull_request_target\b", max_bytes=256 * 1024),
    TextRule("k8s-missing-resource-limits", "Containers without resource limits", "Reliability", "warn", r"^\s*containers:\s*$", "A container can starve its node.", ("**/*.yml", "**/*.yaml"), file_gate=r"(?s)\A(?=.*^?\s*kind:\s*(Deployment|StatefulSet|DaemonSet|Pod|Job|CronJob)\b)(?!.*\blimits:)", opt_in=True),
    TextRule("k8s-host-namespace", "Pod shares a host namespace", "Security", "error", r"^\s*(hostNetwork|hostPID|hostIPC):\s*true\b", "The pod shares a host namespace.", ("**/*.yml", "**/*.yaml"), file_gate=r"(?m)^kind:\s*(?!DaemonSet)\w+"),
    TextRule("k8s-privileged-container", "Container runs privileged", "Security", "error", r"^\s*(privileged|allowPrivilegeEscalation):\s*true\b", "The container has the node's rights.", ("**/*.yml", "**/*.yaml"), file_gate=r"(?m)^kind:\s*\w+"),
    TextRule("dockerfile-copies-dotenv-into-image", "Dotenv file copied into an image layer", "Security", "error", r"(?i)^\s*(COPY|ADD)\s+(?:--\S+\s+)*(?:\S+\s+)*?(?:\S*/)?\.env(?:\.(?!example|sample|template|dist)\w+)?\s+\S+", "A dotenv file becomes part of the image.", ("**/Dockerfile*", "**/*.dockerfile", "Dockerfile*")),
    TextRule("migration-index-without-concurrently", "Index built without CONCURRENTLY", "Reliability", "warn", r"(?i)\bCREATE\s+(UNIQUE\s+)?INDEX\s+(?!CONCURRENTLY)", "The build locks writes out.", MIGRATIONS, file_gate=POSTGRES),
    TextRule("migration-add-not-null-without-default", "NOT NULL column without a default", "Reliability", "error", r"(?i)\bADD\s+(COLUMN\s+)?(?!CONSTRAINT)\S+\s+[^;,]*\bNOT\s+NULL\b", "Existing rows violate the constraint.", MIGRATIONS, unless=r"(?i)\bDEFAULT\b|\bGENERATED\b|\bSERIAL\b"),
    TextRule("migration-destructive-without-guard", "Destructive statement", "Reliability", "error", r"(?i)^\s*(DROP\s+(TABLE|COLUMN|SCHEMA)|TRUNCATE)\b|\bDROP\s+COLUMN\b", "Data is dropped.", MIGRATIONS, unless=r"(?i)\b(tmp|temp|backup|old)_|_(tmp|temp|backup|old)\b"),
    TextRule("migration-foreign-key-without-not-valid", "Foreign key validated under lock", "Reliability", "warn", r"(?i)\bADD\s+CONSTRAINT\s+\S+\s+FOREIGN\s+KEY\b", "Validation locks both tables.", MIGRATIONS, unless=r"(?i)\bNOT\s+VALID\b", file_gate=POSTGRES),
    TextRule("migration-column-type-rewrite", "Column type change rewrites the table", "Reliability", "warn", r"(?i)\bALTER\s+COLUMN\s+\S+\s+(SET\s+DATA\s+)?TYPE\b", "The table is rewritten under lock.", MIGRATIONS, file_gate=POSTGRES),
    TextRule("migration-volatile-column-default", "Volatile default rewrites the table", "Reliability", "warn", r"(?i)\bADD\s+(COLUMN\s+)?\S+\s+[^;]*\bDEFAULT\s+(gen_random_uuid|uuid_generate_v\d|random|clock_timestamp|nextval)\s*\(", "The default is computed row by row.", MIGRATIONS, file_gate=POSTGRES),
    TextRule("no-unpinned-dependency", "Unpinned dependency", "Security", "warn", r'"[@\w./-]+"\s*:\s*"(\*|latest|next|x|git\+[^"]*|https?://[^"]*|github:[^"]*)"', "The dependency can move.", ("**/package.json", "package.json"), opt_in=True),
)


def line_findings(texts: DataFrame, rules: tuple[TextRule, ...], path: str = "path", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, diagnostic, title, category, severity, line, col, message, evidence) of all line rules, after columns to keep."""
    hits = []
    for r in rules:
        gate = F.octet_length(text) <= r.max_bytes
        if r.globs:
            gate = gate & F.col(path).rlike(any_glob(list(r.globs)))
        if r.file_gate:
            gate = gate & F.col(text).rlike(ascii_edges(r.file_gate))

        found = F.filter("_lines", _tester(r))
        if r.first_only:
            found = F.slice(found, 1, 1)
        made = F.transform(found, _maker(r))
        hits.append(F.when(gate, made).otherwise(F.array().cast("array<struct<diagnostic:string,title:string,category:string,severity:string,message:string,line:int,col:int,evidence:string>>")))
    lines = texts.select(path, *keep, text, F.transform(F.split(text, "\n"), _with_number).alias("_lines"))
    return lines.select(path, *keep, F.explode(F.flatten(F.array(*hits))).alias("x")).select(path, *keep, "x.*")


def _tester(r: TextRule):
    """Lambdas of higher-order functions take their arity from the signature, so what they close over comes from here."""
    pattern, unless = ascii_edges(r.pattern), r.unless and ascii_edges(r.unless)
    if unless:
        return lambda s: s["evidence"].rlike(pattern) & ~s["evidence"].rlike(unless)
    return lambda s: s["evidence"].rlike(pattern)


def _maker(r: TextRule):
    fixed = [F.lit(v).alias(k) for k, v in (("diagnostic", r.id), ("title", r.title), ("category", r.category), ("severity", r.severity), ("message", r.message))]
    pattern = ascii_edges(r.pattern)
    return lambda s: F.struct(*fixed, s["line"].alias("line"), F.greatest(F.regexp_instr(s["evidence"], F.lit(pattern)), F.lit(1)).alias("col"), s["evidence"].alias("evidence"))


def _with_number(x: Column, i: Column) -> Column:
    return F.struct((i + 1).cast("int").alias("line"), x.alias("evidence"))


def overbroad_iam(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Finding rows of block_iam."""
    return block_iam(texts, path, text).select(F.col(path).alias("norm_path"), "line", F.lit(1).alias("col"), F.lit("no-overbroad-iam-policy").alias("diagnostic"))


def open_ingress(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """no-open-security-group: a range that is open to the world with a port for administration 6 lines before to 5 after."""
    world, port = r"0\.0\.0\.0/0|::/0", r"(?i)\b(from_port|to_port|FromPort|ToPort)[\"']?\s*[:=]\s*(22|3389|3306|5432|6379|27017)\b"
    lines = F.transform(F.split(F.regexp_replace(text, r"(?m)(#|//).*$", ""), "\n"), lambda x: x)
    t = texts.filter(F.col(path).rlike(any_glob(list(IAC)))).select(path, lines.alias("_l"))
    t = t.select(path, "_l", F.explode(F.filter(F.sequence(F.lit(1), F.size("_l")), lambda i: F.element_at("_l", i).rlike(world))).alias("line"))
    around = F.array_join(F.slice("_l", F.greatest(F.col("line") - 6, F.lit(1)), F.least(F.col("line") - 1, F.lit(6)) + 6), "\n")
    outward = around.rlike(r"(?i)\begress\b")
    return t.filter(around.rlike(port) & ~outward).select(F.col(path).alias("norm_path"), "line", F.lit(1).alias("col"), F.lit("no-open-security-group").alias("diagnostic"))


def unindexed_foreign_keys(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """migration-missing-index-on-foreign-key: a column that a file's foreign key names and none of its indexes begins with."""
    keys = F.regexp_extract_all(text, F.lit(r"(?i)FOREIGN\s+KEY\s*\(\s*[\"`]?(\w+)[\"`]?\s*\)"), 1)
    indexes = F.regexp_extract_all(text, F.lit(r"(?i)INDEX\s+[^;]*?\(\s*[\"`]?(\w+)"), 1)
    t = texts.filter(F.col(path).rlike(any_glob(list(MIGRATIONS)))).select(path, F.explode(F.array_except(F.transform(keys, F.lower), F.transform(indexes, F.lower))).alias("column"))
    return t.select(F.col(path).alias("norm_path"), "column", F.lit("migration-missing-index-on-foreign-key").alias("diagnostic"))


def block_iam(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Lines that allow every action on every resource: the 25 lines from an Allow, cut at the next one."""
    lines = F.split(F.regexp_replace(text, r"(?m)(#|//).*$", ""), "\n")
    allow, action, resource = r"""(?i)["']?Effect["']?\s*[:=]\s*["']?Allow""", r"""(?i)["']?Action["']?\s*[:=]\s*(\[[^\]]*)?["']\*["']""", r"""(?i)["']?Resource["']?\s*[:=]\s*(\[[^\]]*)?["']\*["']"""
    t = texts.filter(F.col(path).rlike(any_glob(list(IAC)))).select(path, lines.alias("_l"))
    t = t.select(path, "_l", F.explode(F.filter(F.sequence(F.lit(1), F.size("_l")), lambda i: F.element_at("_l", i).rlike(allow))).alias("line"))
    rest = F.array_join(F.slice("_l", F.col("line") + 1, F.lit(24)), "\n")
    own = F.concat(F.element_at("_l", F.col("line")), F.lit("\n"), F.element_at(F.split(rest, allow), 1))
    return t.withColumn("_s", own).filter(F.col("_s").rlike(action) & F.col("_s").rlike(resource)).select(path, "line")


def conflicting_dependencies(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Packages that a manifest declares twice, as a dependency and as a development dependency."""
    m = F.from_json(text, "dependencies map<string,string>, devDependencies map<string,string>")
    both = F.array_sort(F.array_intersect(F.map_keys(m["dependencies"]), F.map_keys(m["devDependencies"])))
    return texts.filter(F.col(path).rlike(any_glob(["**/package.json", "package.json"]))).select(path, F.explode(both).alias("package"))


def sensitive_file(path: Column, text: Column) -> Column:
    """Name first, then content, placeholder lines not counted."""
    placeholder = r"(?i)(example|placeholder|changeme|your[-_]|xxxx|<[^>]+>|\$\{)"
    secret = r"(?i)^\s*(?:export\s+)?[\w.-]*(secret|token|password|api[-_]?key)[\w.-]*\s*[:=]\s*\S{8,}"
    return (
        F.when(path.rlike(r"(?i)(^|/)\.env(\.(?!example|sample|template|dist)[^/]+)?$"), "environment")
        .when(path.rlike(r"(?i)\.(pem|key|p12|pfx)$|(^|/)id_(rsa|dsa|ecdsa|ed25519)$"), "key")
        .when(text.rlike("-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"), "key")
        .when(F.exists(F.split(text, "\n"), lambda x: x.rlike(secret) & ~x.rlike(placeholder)), "secret")
    )


def text_findings(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(norm_path, line, diagnostic) of all text rules, line by line and structural."""
    from factloom.sources import files

    out = line_findings(texts, LINE_RULES, path, text).select(F.col(path).alias("norm_path"), "line", "diagnostic")
    docker = files.dockerfile(texts.filter(F.col(path).rlike(r"(^|/)Dockerfile[^/]*$|\.dockerfile$")).select(F.col(path).alias("path"), F.col(text).alias("text")))
    more = [
        overbroad_iam(texts, path, text), open_ingress(texts, path, text), unindexed_foreign_keys(texts, path, text).withColumn("line", F.lit(1)), files.runs_as_root(docker),
        conflicting_dependencies(texts, path, text).select(F.col(path).alias("norm_path"), F.lit(1).alias("line"), F.lit("no-conflicting-dependency-declaration").alias("diagnostic")),
        files.mutable_base_images(docker).select(F.col("path").alias("norm_path"), "line", F.lit("dockerfile-mutable-base-tag").alias("diagnostic")),
    ]
    for m in more:
        out = out.unionByName(m.select("norm_path", F.col("line").cast("int").alias("line"), "diagnostic"))
    return out
