"""Rules over code facts.

A local rule is a predicate on one fact; all of them are compiled into one projection, so that facts are read once
however many rules run. Rules that compare facts with each other are semi- and anti-joins inside a file or function.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vocabularies that rules refer to.
SYNC_IO = "readFileSync writeFileSync appendFileSync existsSync statSync lstatSync readdirSync mkdirSync rmSync unlinkSync copyFileSync execSync spawnSync execFileSync gzipSync gunzipSync deflateSync inflateSync pbkdf2Sync scryptSync".split()
QUERY = "query findMany findUnique findFirst findOne findAll find create createMany update updateMany upsert delete deleteMany save insert insertOne updateOne deleteOne execute aggregate".split()
DB_ROOTS = "db prisma pool client knex sequelize connection conn pg mysql mongo collection repository repo orm".split()
CORE_MODULES = "assert buffer child_process cluster crypto dgram dns events fs http http2 https net os path perf_hooks process querystring readline stream string_decoder timers tls tty url util v8 vm worker_threads zlib".split()
DB_WRITE = "create createMany update updateMany upsert delete deleteMany save insert insertOne updateOne deleteOne destroy".split()
LLM_CALLS = r"\b(openai|anthropic|llm|ai|genai|cohere|mistral)\b.*\.(create|generate|generateText|generateContent|invoke|complete|chat)$"
SECRET_NAME = r"(?i)(password|passwd|secret|token|api[_-]?key|private[_-]?key|credential)"
TAINT = r"\b(req|request|ctx\.request|ctx|event)\.(body|query|params|headers|cookies|url)\b"


def _in(column: str, words) -> str:
    return f"{column} IN ({', '.join(repr(w) for w in words)})"


CALL = "kind IN ('call', 'new')"
HANDLER = "(exists(fn_params, p -> p IN ('req', 'request', 'ctx')) )"
DB_CALL = f"(kind = 'call' AND {_in('method', QUERY)} AND ({_in('lower(root)', DB_ROOTS)} OR name RLIKE '(?i)\\\\b(db|prisma|repository|repo|model|collection)\\\\.'))"
TAINTED0 = f"get(args, 0) RLIKE '{TAINT}'".replace("\\", "\\\\")
TAINTED = f"exists(args, a -> a RLIKE '{TAINT}')".replace("\\", "\\\\")


def _re(column: str, pattern: str) -> str:
    return f"{column} RLIKE '" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class CodeRule:
    id: str
    title: str
    category: str
    severity: str
    where: str
    requires: tuple[str, ...] = ()
    requires_any: tuple[str, ...] = ()
    disabled_when: tuple[str, ...] = ()
    opt_in: bool = False
    tests: bool = True


S, R, B, P, M = "Security", "Reliability", "Bugs", "Performance", "Maintainability"
RULES = (
    # promises and loops
    CodeRule("no-async-array-callback", "Async callback passed to a synchronous array method", B, "error", "kind = 'call' AND ((method IN ('forEach', 'filter', 'some', 'every', 'find', 'reduce', 'sort') AND get(arg_kinds, 0) = 'async_function') OR (method = 'map' AND discarded AND get(arg_kinds, 0) = 'async_function'))"),
    CodeRule("no-async-executor", "Async function passed as a Promise executor", B, "error", "kind = 'new' AND name = 'Promise' AND get(arg_kinds, 0) = 'async_function'"),
    CodeRule("no-unbounded-promise-all", "Unbounded Promise.all over a mapped collection", R, "warn", "kind = 'call' AND name IN ('Promise.all', 'Promise.allSettled') AND " + _re("get(args, 0)", r"\.map\s*\(")),
    CodeRule("no-race-without-timeout", "Promise.race with no timeout branch", R, "warn", "kind = 'call' AND name = 'Promise.race' AND get(arg_kinds, 0) = 'array' AND NOT " + _re("get(args, 0)", r"(?i)timeout|abort|delay|sleep|deadline"), opt_in=True),
    CodeRule("require-fetch-timeout", "Outbound fetch without a timeout or abort signal", R, "warn", "kind = 'call' AND name = 'fetch' AND NOT exists(keys, k -> k IN ('signal', 'timeout', '...')) AND (size(args) < 2 OR get(arg_kinds, 1) = 'object')"),
    CodeRule("no-swallowed-error-empty-catch", "Empty catch swallows the error", B, "warn", "kind = 'catch' AND literals['tokens'] = '0'", opt_in=True),
    # bugs
    CodeRule("no-nan-comparison", "Comparison against NaN, whose result is constant", B, "error", "kind = 'compare' AND array_contains(args, 'NaN')"),
    CodeRule("no-throw-literal", "Thrown value is not an Error", B, "warn", "kind = 'throw' AND get(arg_kinds, 0) IN ('string', 'number', 'template', 'object')"),
    CodeRule("no-oversized-timer-delay", "Timer delay overflows 32 bits", B, "error", "kind = 'call' AND name IN ('setTimeout', 'setInterval') AND try_cast(replace(get(args, 1), '_', '') AS DOUBLE) > 2147483647"),
    CodeRule("no-out-of-range-exit-code", "Exit code outside 0-255 is masked", B, "error", "kind = 'call' AND name = 'process.exit' AND NOT coalesce(try_cast(get(args, 0) AS INT) BETWEEN 0 AND 255, true)"),
    CodeRule("no-sparse-array-iteration", "Iterating a pre-sized array, whose holes are skipped", B, "error", f"{CALL} AND " + _re("name", r"^Array\(\)\.(map|forEach|filter|reduce)$")),
    CodeRule("no-string-length-as-content-length", "Content-Length from a character count", B, "error", "(kind = 'prop' AND lower(name) = 'content-length' AND " + _re("value", r"\.length$") + " AND NOT " + _re("value", r"(?i)buffer|byte") + ") OR (kind = 'call' AND method IN ('setHeader', 'header', 'set') AND lower(get(args, 0)) = 'content-length' AND " + _re("get(args, 1)", r"\.length$") + " AND NOT " + _re("get(args, 1)", r"(?i)buffer|byte") + ")"),
    CodeRule("no-constant-condition", "Condition can never vary", B, "warn", "kind = 'loop' AND " + _re("value", r"^while\s*\(\s*(false|0|null|undefined)\s*\)")),
    CodeRule("no-dirname-in-esm", "__dirname in an ES module is a ReferenceError", B, "error", "kind = 'ident' AND name IN ('__dirname', '__filename')", requires=("esm",)),
    CodeRule("no-url-as-filesystem-path", "import.meta.url used as a filesystem path", B, "error", "kind = 'call' AND root IN ('fs', 'path') AND exists(args, a -> a LIKE '%import.meta.url%') AND NOT exists(args, a -> a LIKE '%fileURLToPath%' OR a LIKE '%new URL%')"),
    CodeRule("no-throw-in-finally", "throw or return inside a finally block", B, "warn", "kind IN ('throw', 'return') AND in_finally"),
    CodeRule("no-floating-promise-in-try", "A bare async call in try is not caught", B, "warn", "kind = 'call' AND in_try AND discarded AND NOT awaited AND NOT handled AND name = 'fetch'", opt_in=True),
    CodeRule("no-unclamped-month-shift", "Month shifted without bounding the day", B, "warn", "kind = 'call' AND method IN ('setMonth', 'setUTCMonth') AND size(args) = 1 AND " + _re("get(args, 0)", r"getMonth\(\)\s*[-+]|getUTCMonth\(\)\s*[-+]")),
    CodeRule("no-local-date-as-iso-datestring", "Local midnight rendered as a UTC date", B, "warn", "kind = 'call' AND " + _re("name", r"toISOString\(\)\.(slice|split|substring)$") + " AND exists(idents, i -> i = 'setHours')", disabled_when=("tz:utc",)),
    CodeRule("no-unstable-offset-pagination", "Offset pagination without a stable order", B, "warn", "kind = 'call' AND array_contains(keys, 'skip') AND NOT exists(keys, k -> k IN ('orderBy', 'order', 'sort', 'cursor', '...'))", opt_in=True),
    # event loop and databases
    CodeRule("no-sync-io-in-request-path", "Blocking synchronous I/O on a request path", P, "error", f"kind = 'call' AND {_in('method', SYNC_IO)} AND {HANDLER}"),
    CodeRule("no-sync-bcrypt-in-request-path", "Synchronous bcrypt on a request path", P, "error", f"kind = 'call' AND {_re('root', '(?i)bcrypt')} AND method LIKE '%Sync' AND {HANDLER}"),
    CodeRule("no-process-exit-in-request-path", "process.exit() on a request path", R, "error", f"kind = 'call' AND name = 'process.exit' AND {HANDLER}"),
    CodeRule("no-large-json-parse-in-request-path", "JSON.parse of caller input on a request path", P, "warn", f"kind = 'call' AND name = 'JSON.parse' AND {HANDLER} AND {TAINTED0}"),
    CodeRule("require-pagination-limit", "Unbounded findMany", P, "warn", "kind = 'call' AND method = 'findMany' AND NOT exists(keys, k -> k IN ('take', 'limit', 'cursor', '...')) AND (size(args) = 0 OR get(arg_kinds, 0) = 'object')", requires=("prisma",)),
    CodeRule("no-redos-prone-regex", "Regex with catastrophic backtracking", S, "warn", "kind = 'regex' AND " + _re("value", r"\([^()]*[+*][^()]*\)[+*]")),
    CodeRule("no-query-in-loop", "Database query inside a loop", P, "error", f"{DB_CALL} AND in_loop"),
    CodeRule("no-missing-await-on-query", "Floating database query", B, "error", f"{DB_CALL} AND discarded AND NOT awaited AND NOT handled"),
    CodeRule("no-db-connection-per-request", "Database client built inside a handler", P, "error", f"{CALL} AND (kind = 'new' AND name IN ('PrismaClient', 'Pool', 'Client', 'MongoClient', 'Sequelize', 'Redis') OR name IN ('mysql.createConnection', 'mysql.createPool', 'mongoose.connect', 'knex')) AND {HANDLER}"),
    CodeRule("no-findmany-then-filter-in-js", "Fetch-all then filter in JavaScript", P, "warn", "kind = 'call' AND " + _re("name", r"\b(findMany|findAll)\(\)\.filter$")),
    CodeRule("no-sql-template-interpolation", "SQL built by string interpolation", S, "error", "kind = 'call' AND method IN ('query', 'execute', 'raw', '$queryRawUnsafe', '$executeRawUnsafe') AND interpolated AND " + _re("get(args, 0)", r"(?i)\b(select|insert|update|delete|with|drop|alter)\b")),
    CodeRule("no-nosql-object-injection", "Query object taken from the caller", S, "error", f"kind = 'call' AND method IN ('find', 'findOne', 'updateOne', 'updateMany', 'deleteOne', 'deleteMany', 'countDocuments') AND get(arg_kinds, 0) = 'member' AND {TAINTED0}"),
    # frameworks
    CodeRule("express-async-handler-unprotected", "Async route handler with no error path", R, "error", "kind = 'call' AND method IN ('get', 'post', 'put', 'patch', 'delete', 'all', 'use') AND root IN ('app', 'router') AND exists(arg_kinds, k -> k = 'async_function') AND exists(args, a -> a LIKE 'async%await %' AND NOT a LIKE '%try%')", requires=("express",), disabled_when=("express:5",)),
    CodeRule("fastify-missing-schema", "Fastify route without a schema", R, "warn", "kind = 'call' AND root IN ('fastify', 'app', 'server') AND method IN ('post', 'put', 'patch') AND NOT exists(keys, k -> k IN ('schema', '...'))", requires=("fastify",), opt_in=True),
    CodeRule("no-missing-body-size-limit", "Body parser without a size limit", R, "warn", "kind = 'call' AND name IN ('express.json', 'express.urlencoded', 'bodyParser.json', 'bodyParser.urlencoded') AND NOT exists(keys, k -> k IN ('limit', '...')) AND (size(args) = 0 OR get(arg_kinds, 0) = 'object')", requires=("express",)),
    CodeRule("no-trust-proxy-true", "Express trust proxy set to true", S, "warn", "kind = 'call' AND method = 'set' AND get(args, 0) = 'trust proxy' AND get(args, 1) = 'true'", requires=("express",)),
    CodeRule("no-wildcard-body-parser", "Body parser accepts any content type", S, "warn", "kind = 'call' AND (root IN ('express', 'bodyParser') OR method IN ('json', 'raw', 'text', 'urlencoded')) AND literals['type'] IN ('*/*', '*')", opt_in=True),
    CodeRule("no-status-code-as-response-body", "Status code sent as the body", B, "error", "kind = 'call' AND root IN ('res', 'response') AND method IN ('send', 'json') AND get(arg_kinds, 0) = 'number'", requires=("express:5",)),
    CodeRule("no-express4-removed-api", "API removed in Express 5", B, "error", "kind = 'call' AND (name IN ('app.del', 'req.param', 'res.sendfile', 'req.acceptsCharset', 'req.acceptsEncoding', 'req.acceptsLanguage') OR (name = 'res.redirect' AND get(args, 0) = 'back'))", requires=("express:5",)),
    CodeRule("hapi-route-auth-disabled", "Route disables authentication on a state change", S, "error", "kind = 'call' AND method = 'route' AND upper(literals['method']) IN ('POST', 'PUT', 'PATCH', 'DELETE') AND " + _re("coalesce(literals['options'], literals['config'])", r"\bauth\s*:\s*false"), requires=("hapi",)),
    CodeRule("hapi-route-missing-validation", "Route takes a payload without validation", S, "warn", "kind = 'call' AND method = 'route' AND upper(literals['method']) IN ('POST', 'PUT', 'PATCH') AND coalesce(literals['options'], literals['config']) IS NOT NULL AND NOT " + _re("coalesce(literals['options'], literals['config'])", r"\bvalidate\b"), requires=("hapi",)),
    CodeRule("no-unreturned-hono-response", "Response built and never returned", B, "error", "kind = 'call' AND root = 'c' AND method IN ('json', 'text', 'html', 'body', 'redirect') AND discarded AND array_contains(fn_params, 'c')", requires=("hono",)),
    CodeRule("no-unawaited-koa-next", "next() not awaited in Koa", B, "error", "kind = 'call' AND name = 'next' AND NOT awaited AND discarded AND array_contains(fn_params, 'ctx') AND array_contains(fn_params, 'next')", requires=("koa",)),
    CodeRule("no-unawaited-adonis-validation", "Request validation not awaited", S, "error", "kind = 'call' AND method IN ('validate', 'validateUsing') AND root IN ('request', 'ctx') AND discarded AND NOT awaited", requires=("adonis",)),
    CodeRule("no-unawaited-next-dynamic-api", "Dynamic API used without await", B, "error", "kind = 'call' AND " + _re("name", r"^(cookies|headers|draftMode)\(\)\."), requires=("next:15",)),
    CodeRule("no-unawaited-hono-body", "Request body read without await", B, "error", "kind = 'call' AND " + _re("name", r"^c\.req\.(json|text|parseBody)$") + " AND NOT awaited AND NOT handled AND value = '='", requires=("hono",)),
    # security
    CodeRule("no-eval-with-input", "eval() of a value that is not a literal", S, "error", "kind = 'call' AND name = 'eval' AND get(arg_kinds, 0) <> 'string'"),
    CodeRule("no-function-constructor-with-input", "Function constructor built from input", S, "error", f"{CALL} AND name = 'Function' AND exists(arg_kinds, k -> k <> 'string')"),
    CodeRule("no-exec-with-interpolation", "Shell command built by interpolation", S, "error", "kind = 'call' AND method IN ('exec', 'execSync') AND (root IN ('exec', 'execSync', 'child_process', 'cp') ) AND interpolated"),
    CodeRule("no-shell-command-from-input", "Caller-controlled value parsed by a shell", S, "error", f"kind = 'call' AND method IN ('spawn', 'spawnSync', 'execFile') AND literals['shell'] = 'true' AND {TAINTED}"),
    CodeRule("no-disabled-tls-verification", "TLS verification disabled", S, "error", "(kind = 'prop' AND name = 'rejectUnauthorized' AND value = 'false') OR (kind = 'assign' AND name LIKE '%NODE_TLS_REJECT_UNAUTHORIZED%' AND value = '0')"),
    CodeRule("no-weak-cipher", "Weak cipher", S, "error", "kind = 'call' AND method IN ('createCipheriv', 'createCipher', 'createDecipheriv') AND " + _re("get(args, 0)", r"(?i)^(des|rc4|rc2|bf|.*-ecb)")),
    CodeRule("no-weak-hash-for-password", "Weak hash for a password", S, "error", "kind = 'call' AND method = 'createHash' AND lower(get(args, 0)) IN ('md5', 'sha1', 'sha-1') AND (fn_name RLIKE '(?i)passw' OR exists(fn_params, p -> p RLIKE '(?i)passw'))"),
    CodeRule("no-weak-password-hash-cost", "Password hash below its cost floor", S, "error", "kind = 'call' AND ((root RLIKE '(?i)bcrypt' AND method IN ('hash', 'hashSync', 'genSalt', 'genSaltSync') AND try_cast(get(args, CASE WHEN method LIKE 'gen%' THEN 0 ELSE 1 END) AS INT) < 10) OR (method IN ('pbkdf2', 'pbkdf2Sync') AND try_cast(replace(get(args, 2), '_', '') AS INT) < 100000))"),
    CodeRule("no-weak-crypto-parameters", "Cryptographic parameter below its floor", S, "error", "kind = 'prop' AND name = 'modulusLength' AND try_cast(value AS INT) < 2048"),
    CodeRule("no-static-kdf-salt", "Hard-coded salt", S, "error", "kind = 'call' AND method IN ('pbkdf2', 'pbkdf2Sync', 'scrypt', 'scryptSync') AND get(arg_kinds, 1) = 'string'"),
    CodeRule("no-static-cipher-iv", "Initialization vector is the same every time", S, "error", "kind = 'call' AND method = 'createCipheriv' AND (get(arg_kinds, 2) = 'string' OR " + _re("get(args, 2)", r"^Buffer\.(alloc\(\d+\)|from\(\s*['\"][^'\"]*['\"])") + ")"),
    CodeRule("no-math-random-for-token", "Math.random() for a security value", S, "error", "(kind = 'assign' AND value LIKE '%Math.random()%' AND " + _re("name", SECRET_NAME) + ") OR (kind = 'call' AND name = 'Math.random' AND " + _re("fn_name", SECRET_NAME) + ")"),
    CodeRule("no-predictable-security-token", "Predictable security value", S, "error", "kind = 'assign' AND " + _re("name", SECRET_NAME) + " AND " + _re("value", r"\b(uuidv1|uuid\.v1|Date\.now)\(\)")),
    CodeRule("no-jwt-none-algorithm", "JWT verified with the none algorithm", S, "error", "kind = 'call' AND root RLIKE '(?i)jwt' AND literals['algorithms'] RLIKE '(?i)[\\'\"]none[\\'\"]'", requires=("jsonwebtoken",)),
    CodeRule("require-jwt-algorithms-allowlist", "jwt.verify without an allowlist of algorithms", S, "warn", "kind = 'call' AND root RLIKE '(?i)jwt' AND method = 'verify' AND NOT exists(keys, k -> k IN ('algorithms', '...')) AND (size(args) < 3 OR get(arg_kinds, 2) <> 'ident')", requires=("jsonwebtoken",)),
    CodeRule("jwt-missing-expiration", "JWT signed without an expiration", S, "warn", "kind = 'call' AND root RLIKE '(?i)jwt' AND method = 'sign' AND NOT exists(keys, k -> k IN ('expiresIn', 'exp', '...')) AND get(arg_kinds, 0) = 'object' AND (size(args) < 3 OR get(arg_kinds, 2) = 'object')", requires=("jsonwebtoken",)),
    CodeRule("no-sensitive-data-in-jwt-payload", "Credential in a JWT payload", S, "error", "kind = 'call' AND root RLIKE '(?i)jwt' AND method = 'sign' AND exists(keys, k -> k RLIKE '(?i)^(password|passwordHash|secret|ssn|creditCard|apiKey)$')", requires=("jsonwebtoken",)),
    CodeRule("no-jwt-decode-as-verify", "jwt.decode() used for authorization", S, "error", "kind = 'call' AND root RLIKE '(?i)jwt' AND method = 'decode' AND " + HANDLER, requires=("jsonwebtoken",)),
    CodeRule("no-sensitive-data-in-logs", "Secret written to a log", S, "warn", "kind = 'call' AND root IN ('console', 'logger', 'log') AND exists(arg_kinds, k -> k IN ('ident', 'member')) AND exists(args, a -> a RLIKE '^[\\\\w.]*(?i)(password|secret|accessToken|apiKey|privateKey)$')"),
    CodeRule("no-error-leak-to-client", "Error stack sent to the client", S, "error", "kind = 'call' AND root IN ('res', 'response', 'reply', 'ctx') AND method IN ('json', 'send', 'end') AND exists(args, a -> a RLIKE '\\\\b(err|error|e)\\\\.stack\\\\b')"),
    CodeRule("no-open-redirect", "Redirect to a caller-controlled URL", S, "error", f"kind = 'call' AND method = 'redirect' AND root IN ('res', 'response', 'reply', 'ctx', 'c') AND {TAINTED}"),
    CodeRule("no-path-traversal", "Path built from caller input", S, "error", f"kind = 'call' AND name IN ('path.join', 'path.resolve') AND {TAINTED}"),
    CodeRule("no-ssrf-unvalidated-url", "Outbound request to a caller-controlled URL", S, "error", f"kind = 'call' AND (name = 'fetch' OR root IN ('axios', 'got', 'superagent')) AND {TAINTED0}", opt_in=True),
    CodeRule("no-unsafe-deserialization", "Unsafe deserialization of caller data", S, "error", f"kind = 'call' AND method IN ('unserialize', 'deserialize', 'load') AND root IN ('serialize', 'v8', 'yaml', 'jsyaml') AND {TAINTED0}"),
    CodeRule("no-unsafe-regexp-from-input", "RegExp built from caller input", S, "warn", f"{CALL} AND name = 'RegExp' AND {TAINTED0}"),
    CodeRule("no-vm-run-untrusted", "vm runs code that is not a literal", S, "error", f"{CALL} AND (name IN ('vm.runInNewContext', 'vm.runInThisContext', 'vm.runInContext') OR name = 'vm.Script') AND get(arg_kinds, 0) <> 'string'"),
    CodeRule("no-mass-assignment", "Whole request body written into a record", S, "error", f"kind = 'call' AND method IN ('create', 'update', 'insert', 'upsert', 'insertOne', 'save') AND (get(args, 0) RLIKE '^(req|request|ctx[.]request)[.]body$' OR literals['data'] RLIKE '^(req|request|ctx[.]request)[.]body$' OR exists(args, a -> a RLIKE '[.]{{3}}(req|request)[.]body'))"),
    CodeRule("no-substring-host-check", "Host allowlist by substring", S, "error", "kind = 'call' AND method IN ('includes', 'startsWith', 'endsWith', 'indexOf') AND root RLIKE '(?i)(url|origin|host|referer|redirect)' AND get(arg_kinds, 0) = 'string' AND " + _re("get(args, 0)", r"^(https?://)?[\w-]+(\.[\w-]+)+")),
    CodeRule("require-secure-cookie-flags", "Cookie without secure or httpOnly", S, "warn", "kind = 'call' AND method IN ('cookie', 'setCookie') AND root IN ('res', 'response', 'reply') AND get(args, 0) RLIKE '(?i)(session|token|auth|sid|jwt)' AND NOT (coalesce(literals['httpOnly'], '') = 'true' AND coalesce(literals['secure'], '') = 'true') AND NOT array_contains(keys, '...')"),
    CodeRule("graphql-introspection-in-production", "Introspection hard-coded on", S, "error", "kind = 'prop' AND name = 'introspection' AND value = 'true'", tests=False),
    CodeRule("cors-credentials-reflect", "Credentials with a reflected origin", S, "error", "kind = 'call' AND (name = 'cors' OR method = 'enableCors') AND literals['credentials'] = 'true' AND literals['origin'] IN ('true', '*')"),
    CodeRule("no-hardcoded-secret-fallback", "Hard-coded fallback for a secret", S, "error", "kind = 'assign' AND " + _re("name", SECRET_NAME) + " AND " + _re("value", r"process\.env\.\w+\s*(\|\||\?\?)\s*['\"][^'\"]{6,}['\"]") + " AND NOT " + _re("value", r"(?i)changeme|example|placeholder|your[-_]")),
    # reliability
    CodeRule("no-uncatchable-signal-handler", "Handler for a signal that cannot be caught", R, "error", "kind = 'call' AND name IN ('process.on', 'process.once') AND get(args, 0) IN ('SIGKILL', 'SIGSTOP')"),
    CodeRule("no-listener-added-per-request", "Listener added on every request", R, "warn", f"kind = 'call' AND method IN ('on', 'addListener') AND {HANDLER} AND root IN ('process', 'emitter', 'bus', 'events')"),
    CodeRule("no-literal-listener-removal", "Listener removed by a function that was never added", R, "error", "kind = 'call' AND method IN ('removeListener', 'off', 'removeEventListener') AND size(args) >= 2 AND (get(arg_kinds, 1) IN ('function', 'async_function') OR get(args, 1) LIKE '%.bind(%')", tests=False),
    CodeRule("no-invalid-cron-expression", "Malformed cron expression", B, "error", "kind = 'call' AND name IN ('cron.schedule', 'schedule.scheduleJob') AND get(arg_kinds, 0) = 'string' AND NOT size(split(trim(get(args, 0)), ' +')) IN (5, 6)", opt_in=True),
    CodeRule("no-cache-without-ttl", "Cache write with no expiry", R, "warn", "kind = 'call' AND root RLIKE '(?i)^(redis|cache|memcached)' AND method = 'set' AND size(args) = 2", opt_in=True),
    # models
    CodeRule("ai-call-in-loop", "Model call inside a loop", P, "warn", "kind = 'call' AND " + _re("name", LLM_CALLS) + " AND in_loop", requires=("ai",)),
    CodeRule("require-llm-token-limit", "Model call with no output limit", P, "warn", "kind = 'call' AND " + _re("name", LLM_CALLS) + " AND NOT exists(keys, k -> k IN ('max_tokens', 'maxTokens', 'max_output_tokens', 'maxOutputTokens', 'max_completion_tokens', '...'))", requires=("ai",), opt_in=True),
    CodeRule("no-prompt-injection", "Untrusted input in a prompt", S, "error", "kind = 'call' AND " + _re("name", LLM_CALLS) + f" AND {TAINTED}", requires=("ai",)),
    CodeRule("no-unguarded-llm-json-parse", "Model output parsed without error handling", R, "error", "kind = 'call' AND name = 'JSON.parse' AND NOT in_try AND " + _re("get(args, 0)", r"(?i)\b(completion|response|result|message|choice|output|llm|model)\w*\??(\.|\[).*(content|text|output)"), requires=("ai",)),
    CodeRule("no-system-prompt-leak", "System prompt sent to the caller", S, "warn", "kind = 'call' AND root IN ('res', 'response', 'reply', 'ctx', 'c') AND method IN ('json', 'send', 'end', 'text') AND exists(idents, i -> i RLIKE '(?i)^system_?prompt')", requires=("ai",)),
    CodeRule("mcp-tool-unrestricted-capability", "Tool runs a powerful operation on model input", S, "error", "kind = 'call' AND method IN ('tool', 'registerTool', 'addTool') AND exists(args, a -> a RLIKE '\\\\b(exec|execSync|spawn|eval|writeFile|writeFileSync|unlink|rm|query)[(]')", requires=("mcp",)),
    # values and promises
    CodeRule("no-bigint-precision-loss", "BigInt coerced to a number", B, "warn", "kind = 'call' AND name IN ('Number', 'parseInt', 'parseFloat') AND " + _re("get(args, 0)", r"^(\d[\d_]*n|BigInt\()")),
    CodeRule("no-broken-sort-comparator", "Comparator that cannot order", B, "error", "kind = 'call' AND method IN ('sort', 'toSorted') AND " + _re("get(args, 0)", r"=>\s*(\(?[\w.\[\]]+\s*[<>]=?\s*[\w.\[\]]+\)?|Math\.random\(\)\s*[-<>].*|(true|false|0|1))$")),
    CodeRule("no-tofixed-as-number", "A toFixed string added to a number", B, "warn", "kind IN ('assign', 'return') AND " + _re("value", r"\.toFixed\([^)]*\)\s*\+\s*\d|\d\s*\+\s*[\w.]+\.toFixed\(")),
    CodeRule("no-unclonable-worker-message", "Function posted to a worker", B, "error", "kind = 'call' AND method = 'postMessage' AND (get(arg_kinds, 0) IN ('function', 'async_function') OR (get(arg_kinds, 0) = 'object' AND " + _re("get(args, 0)", r"=>|\bfunction\b") + "))", opt_in=True),
    CodeRule("no-unreachable-code", "Code after a statement that ends the block", B, "warn", "kind IN ('return', 'throw') AND literals['prev'] IN ('{', '}', ';') AND NOT literals['next'] IN ('}', '', 'case', 'default', 'function', 'async', ')', ',')"),
    CodeRule("no-dropped-abort-signal", "Abort signal accepted and not passed on", R, "warn", "kind = 'call' AND name = 'fetch' AND array_contains(fn_params, 'signal') AND NOT array_contains(idents, 'signal')"),
    CodeRule("no-infinite-retry-without-backoff", "Retry loop without a bound or a pause", R, "error", "kind = 'loop' AND " + _re("value", r"^while\s*\(\s*(true|1)\s*\)|^for\s*\(\s*;\s*;\s*\)") + " AND array_contains(idents, 'catch') AND NOT exists(idents, i -> i RLIKE '(?i)^(sleep|wait|break|pause)|settimeout|delay|backoff')"),
    CodeRule("no-unhandled-pipe-error", "Chained pipes without an error handler", R, "warn", "kind = 'call' AND " + _re("name", r"pipe\(\)\.pipe$")),
    CodeRule("no-unchecked-required-env", "Environment value used as if always set", R, "warn", "kind IN ('call', 'member') AND " + _re("name", r"^process\.env\.[A-Z_][A-Z0-9_]*\.\w+"), requires=("node",), opt_in=True),
    CodeRule("no-liveness-check-with-dependency", "Liveness check that asks a dependency", R, "warn", "kind = 'call' AND method = 'get' AND " + _re("get(args, 0)", r"(?i)^/(healthz|livez|liveness|health/live)$") + " AND exists(args, a -> a RLIKE '(?i)\\\\b(db|prisma|redis|pool|client|mongoose|knex)[.]')"),
    # responses
    CodeRule("graphql-resolver-returns-raw-error", "Error stack returned by a resolver", S, "warn", "kind = 'return' AND in_catch AND coalesce(catch_param, '') <> '' AND value LIKE concat('%', catch_param, '.stack%')"),
    CodeRule("no-xss-in-html-response", "Caller input written into HTML", S, "error", "kind = 'call' AND root IN ('res', 'response', 'reply', 'c') AND method IN ('send', 'end', 'write', 'html') AND interpolated AND " + _re("get(args, 0)", r"<\w+") + f" AND {TAINTED0}"),
    CodeRule("no-state-change-on-get", "State changed by a GET route", S, "warn", "kind = 'call' AND method = 'get' AND root IN ('app', 'router', 'fastify', 'server') AND get(args, 0) LIKE '/%' AND exists(args, a -> a RLIKE '[.](" + "|".join(DB_WRITE) + ")[(]')"),
    CodeRule("no-unawaited-adonis-auth-check", "Authentication check used without await", S, "error", "kind = 'call' AND " + _re("name", r"\bauth(\.use\(\))?\.(check|authenticate|isAuthenticated)$") + " AND NOT awaited AND NOT handled AND value <> 'return'", requires=("adonis",)),
    # more security
    CodeRule("no-prototype-pollution", "Caller's object merged deeply", S, "error", f"kind = 'call' AND (name IN ('_.merge', '_.mergeWith', '_.defaultsDeep', 'lodash.merge', 'merge', 'deepmerge', 'extend') AND {TAINTED} OR name = '$.extend' AND {TAINTED})"),
    CodeRule("no-nondeterministic-stable-key", "Stable key made of a clock or chance", S, "warn", "kind = 'assign' AND " + _re("name", r"(?i)(idempotency_?key|cache_?key|dedupe_?key|etag)$") + " AND " + _re("value", r"Date\.now\(|Math\.random\(|randomUUID\(|new Date\(\)")),
    CodeRule("no-unanchored-security-regex", "Security pattern that is not anchored", S, "error", "kind = 'assign' AND " + _re("name", r"(?i)(origin|host|domain|redirect|allow\w*)(_?(re|regex|pattern))?$") + " AND value LIKE '/%' AND NOT " + _re("value", r"^/\^.*\$/[a-z]*$")),
    CodeRule("no-unsafe-archive-extraction", "Archive entry's name joined to a path", S, "error", "kind = 'call' AND name IN ('path.join', 'path.resolve') AND exists(args, a -> a RLIKE '\\\\b(entry|header|file|zipEntry)[.](path|fileName|entryName|name)$')"),
    # tests and stubs
    CodeRule("no-assertion-free-test", "Test without an assertion", M, "warn", "kind = 'call' AND name IN ('it', 'test') AND exists(arg_kinds, k -> k IN ('function', 'async_function')) AND NOT exists(idents, i -> i RLIKE '(?i)^(expect|assert|should|verify)')", opt_in=True),
    CodeRule("no-flaky-test-pattern", "Test that depends on a clock or chance", M, "warn", "kind = 'call' AND name IN ('Math.random', 'setTimeout') AND " + _re("file", r"\.(test|spec)\.[cm]?[jt]sx?$"), opt_in=True),
    CodeRule("no-redundant-try-catch-rethrow", "Catch that only throws again", M, "warn", "kind = 'catch' AND CAST(literals['tokens'] AS INT) BETWEEN 2 AND 3 AND array_contains(idents, 'throw') AND coalesce(value, '') <> '' AND array_contains(idents, value)"),
    CodeRule("no-unimplemented-stub", "Stub that throws", M, "warn", "kind = 'throw' AND " + _re("value", r"(?i)\b(not (yet )?implemented|unimplemented|todo)\b")),
    CodeRule("no-dead-async", "Async function that awaits nothing", M, "warn", "kind = 'function' AND value = 'async' AND literals['awaits'] = 'false' AND literals['tokens'] <> '0' AND NOT exists(idents, i -> i = 'return')", opt_in=True),
    CodeRule("high-cyclomatic-complexity", "Function with too many paths", M, "warn", "kind = 'function' AND CAST(literals['complexity'] AS INT) > 15", opt_in=True),
    CodeRule("deep-nesting", "Control flow nested too deeply", M, "warn", "kind = 'function' AND CAST(literals['depth'] AS INT) >= 5", opt_in=True),
    # maintainability
    CodeRule("no-console-log-in-committed-code", "console.log left in committed code", M, "warn", "kind = 'call' AND name IN ('console.log', 'console.debug')", opt_in=True, tests=False),
    CodeRule("prefer-node-protocol-imports", "Core module without the node: protocol", M, "warn", f"kind = 'import' AND {_in('name', CORE_MODULES)}", opt_in=True),
    CodeRule("max-function-length", "Function is too long", M, "warn", "kind = 'function' AND CAST(literals['lines'] AS INT) > 60", opt_in=True),
    CodeRule("no-node-builtin-on-edge", "Node built-in in an edge project", R, "error", f"kind = 'import' AND ({_in('name', CORE_MODULES)} OR name LIKE 'node:%')", requires=("edge",)),
    CodeRule("no-deprecated-node-api", "Deprecated Node API", M, "warn", f"{CALL} AND (name IN ('url.parse', 'fs.exists', 'util.isArray', 'util.isRegExp', 'util.isDate', 'crypto.createCipher', 'crypto.createDecipher', 'domain.create') OR (name = 'Buffer'))"),
)


def local_findings(facts: DataFrame, rules: tuple[CodeRule, ...] = RULES, path: str = "file") -> DataFrame:
    """(norm_path, line, col, diagnostic, title, category, severity, message, evidence, requires, requires_any, disabled_when, opt_in)."""
    test = F.col(path).rlike(r"(?i)(^|/)(__tests__|__mocks__)(/|$)|\.(test|spec)\.[cm]?[jt]sx?$|(^|/)tests?/")
    text = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    each = []
    for r in rules:
        hit = F.coalesce(F.expr(r.where), F.lit(False))
        if not r.tests:
            hit = hit & ~test
        each.append(F.when(hit, F.struct(F.lit(r.id).alias("diagnostic"), F.lit(r.title).alias("title"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.lit(r.opt_in).alias("opt_in"), text(r.requires).alias("requires"), text(r.requires_any).alias("requires_any"), text(r.disabled_when).alias("disabled_when"))))
    x = facts.select(F.col(path).alias("norm_path"), "line", "col", F.coalesce("name", F.lit("")).alias("_n"), F.coalesce("value", F.lit("")).alias("_v"), F.explode(F.array_compact(F.array(*each))).alias("r"))
    return x.select("norm_path", "line", "col", "r.*", F.col("r.title").alias("message"), F.concat_ws(" ", "_n", "_v").alias("evidence"))


def gated(found: DataFrame, capabilities) -> DataFrame:
    """Findings whose rule the project's capabilities (a column or literal array) allow; opt-in rules are left out."""
    from factloom.operators.selection import capability_gate

    return found.filter(~F.col("opt_in") & capability_gate(capabilities, F.col("requires"), F.col("requires_any"), F.col("disabled_when")))


def relational_findings(facts: DataFrame) -> DataFrame:
    """(norm_path, line, col, diagnostic) of rules that compare facts."""
    f = facts.withColumnRenamed("file", "norm_path")
    here = ["norm_path", "line", "col"]

    def put(df: DataFrame, name: str) -> DataFrame:
        return df.select(*here, F.lit(name).alias("diagnostic"))

    calls = f.filter("kind = 'call'")
    out = []
    # a route registered twice, and one that an earlier pattern of the same router and method covers
    routes = calls.filter("method IN ('get', 'post', 'put', 'patch', 'delete') AND root IN ('app', 'router', 'server', 'fastify') AND get(arg_kinds, 0) = 'string' AND get(args, 0) LIKE '/%'").withColumn("path", F.get("args", F.lit(0)))
    w = Window.partitionBy("norm_path", "root", "method", "path").orderBy("pre")
    out.append(put(routes.withColumn("_n", F.row_number().over(w)).filter("_n > 1"), "no-duplicate-route-definition"))
    general = routes.filter("path RLIKE ':'").select("norm_path", "root", "method", F.col("pre").alias("_pre"), F.concat(F.lit("^"), F.regexp_replace("path", r":\w+", "[^/]+"), F.lit("$")).alias("_re"))
    out.append(put(routes.filter("NOT path RLIKE ':'").join(general, ["norm_path", "root", "method"]).filter("_pre < pre AND path RLIKE _re").select(*here).distinct(), "no-shadowed-route"))
    # settled results read without a look at their status
    settled = f.filter("kind = 'assign' AND value LIKE '%Promise.allSettled(%'").select(*here)
    status = f.filter("(kind = 'member' AND method = 'status') OR array_contains(idents, 'status')").filter("kind IN ('member', 'compare', 'call')").select("norm_path").distinct()
    value = f.filter("kind = 'member' AND method = 'value'").select("norm_path").distinct()
    out.append(put(settled.join(value, "norm_path", "left_semi").join(status, "norm_path", "left_anti"), "no-unchecked-allsettled-result"))
    # servers, intervals, caches: what the file never does
    def files(where: str) -> DataFrame:
        return f.filter(where).select("norm_path").distinct()

    listen = calls.filter("method = 'listen' AND root IN ('app', 'server', 'fastify', 'httpServer')")
    out.append(put(listen.join(files("kind = 'call' AND name IN ('process.on', 'process.once') AND get(args, 0) = 'SIGTERM'"), "norm_path", "left_anti"), "require-sigterm-handler"))
    interval = calls.filter("name = 'setInterval' AND fn = -1 AND NOT handled")
    out.append(put(interval.join(files("kind = 'call' AND (name = 'clearInterval' OR method = 'unref')"), "norm_path", "left_anti"), "no-uncleared-module-interval"))
    cache = f.filter("kind = 'assign' AND fn = -1 AND value RLIKE '^new (Map|Set)\\\\(\\\\)'").withColumn("cache", F.regexp_extract("name", r"(\w+)$", 1))
    writes = calls.filter("method IN ('set', 'add')").select("norm_path", F.col("root").alias("cache")).distinct()
    evicts = calls.filter("method IN ('delete', 'clear')").select("norm_path", F.col("root").alias("cache")).distinct()
    out.append(put(cache.join(writes, ["norm_path", "cache"], "left_semi").join(evicts, ["norm_path", "cache"], "left_anti"), "no-unbounded-module-cache"))
    # network calls inside a transaction
    outer = calls.filter("method = '$transaction' OR method = 'transaction'").select("norm_path", F.col("pre").alias("_a"), F.col("post").alias("_b"))
    net = calls.filter("name = 'fetch' OR root IN ('axios', 'got', 'superagent')")
    out.append(put(net.join(outer, "norm_path").filter("_a < pre AND post < _b").select(*here).distinct(), "no-external-call-inside-open-transaction"))
    # errors: a catch that throws a new error and drops the old one, streams without an error handler
    caught = f.filter("kind = 'throw' AND in_catch AND value LIKE 'new %' AND coalesce(catch_param, '') <> '' AND NOT array_contains(idents, catch_param)")
    out.append(put(caught, "no-error-cause-discarded"))
    pipes = calls.filter("method = 'pipe' AND name NOT LIKE '%()%'")
    errors = calls.filter("method = 'on' AND get(args, 0) = 'error'").select("norm_path", "root").distinct()
    out.append(put(pipes.join(errors, ["norm_path", "root"], "left_anti"), "no-missing-stream-error-handler"))
    # a write to a module namespace object
    spaces = f.filter("kind = 'import' AND value = 'namespace'").select("norm_path", F.get("args", F.lit(0)).alias("root")).distinct()
    out.append(put(f.filter("kind = 'assign' AND name LIKE '%.%'").join(spaces, ["norm_path", "root"], "left_semi"), "no-namespace-object-write"))
    # a reused global regex
    sticky = f.filter("kind = 'assign' AND value RLIKE '/[a-z]*[gy][a-z]*$' AND value LIKE '/%'").withColumn("root", F.regexp_extract("name", r"(\w+)$", 1)).select("norm_path", "root").distinct()
    out.append(put(calls.filter("method = 'test'").join(sticky, ["norm_path", "root"], "left_semi"), "no-stateful-global-regex-test"))
    out += [put(df, name) for name, df in _pairs(f, calls, files)]
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def _pairs(f: DataFrame, calls: DataFrame, files) -> list[tuple[str, DataFrame]]:
    """More rules that compare facts of a file: (id, the facts that are found)."""
    place = ["norm_path", "pre"]
    out = []

    def missing(name: str, rows: DataFrame, evidence: str) -> None:
        """Rows of files that hold no fact of this kind."""
        out.append((name, rows.join(files(evidence), "norm_path", "left_anti")))

    # what a file builds and never guards
    missing("no-detached-child-without-unref", calls.filter("method IN ('spawn', 'fork') AND literals['detached'] = 'true'"), "kind = 'call' AND method = 'unref'")
    missing("graphql-missing-depth-limit", f.filter("kind IN ('call', 'new') AND name IN ('ApolloServer', 'createYoga', 'graphqlHTTP')"), "exists(idents, i -> i RLIKE '(?i)depthlimit|complexity|costlimit|armor')")
    missing("restify-missing-error-handler", calls.filter("name = 'restify.createServer'"), "kind = 'call' AND method = 'on' AND get(args, 0) RLIKE '(?i)error'")
    missing("require-error-handling-middleware", calls.filter("name = 'app.listen'").join(files("kind = 'call' AND name = 'express'"), "norm_path", "left_semi"), "kind = 'function' AND size(args) = 4")
    missing("no-chunk-string-concat", calls.filter("method = 'on' AND get(args, 0) = 'data' AND get(args, 1) RLIKE '[+]='"), "kind = 'call' AND method IN ('setEncoding', 'StringDecoder') OR kind = 'new' AND name = 'StringDecoder'")
    sockets = f.filter("kind = 'assign' AND value RLIKE '^new (WebSocket|ws)[(]'").withColumn("root", F.regexp_extract("name", r"(\w+)$", 1))
    guarded = calls.filter("method IN ('on', 'addEventListener') AND get(args, 0) = 'error'").select("norm_path", "root").union(f.filter("kind = 'assign' AND name LIKE '%.onerror'").select("norm_path", "root")).distinct()
    out.append(("no-missing-websocket-error-handler", sockets.join(guarded, ["norm_path", "root"], "left_anti")))
    taken = f.filter("kind = 'assign' AND value RLIKE '[.](connect|acquire|getConnection|reserve)[(][)]$'").withColumn("root", F.regexp_extract("name", r"(\w+)$", 1))
    freed = calls.filter("method IN ('release', 'end', 'close', 'destroy')").select("norm_path", "root").distinct()
    out.append(("no-unreleased-resource", taken.join(freed, ["norm_path", "root"], "left_anti")))
    # a status and a body of one chain share their first token
    status = calls.filter("name RLIKE '^(res|response|reply)[.](status|code)$'").select(*place, F.get("args", F.lit(0)).alias("_status"))
    chained = calls.filter("method IN ('json', 'send', 'end') AND size(args) > 0").join(status, place)
    out.append(("no-body-on-bodiless-status", chained.filter("_status IN ('204', '205', '304')")))
    out.append(("no-error-response-with-success-status", chained.filter("_status RLIKE '^2[0-9][0-9]$' AND in_catch AND coalesce(catch_param, '') <> '' AND array_contains(idents, catch_param)")))
    # order inside a function
    handler = ["norm_path", "fn"]
    passed = calls.filter("name = 'next' AND discarded AND size(args) = 0 AND fn >= 0").select(*handler, F.col("pre").alias("_next"))
    sent = calls.filter("root IN ('res', 'response') AND method IN ('json', 'send', 'end', 'render')").join(passed, handler).filter("_next < pre")
    out.append(("no-send-after-next", sent.dropDuplicates(["norm_path", "pre"])))
    private = f.filter("kind = 'member' AND name RLIKE '^req[.](user|session|headers[.]authorization)'").select(*handler).distinct()
    out.append(("no-shared-cache-authenticated-response", calls.filter("method IN ('set', 'setHeader', 'header') AND lower(get(args, 0)) = 'cache-control' AND get(args, 1) RLIKE '(?i)public|s-maxage'").join(private, handler, "left_semi")))
    writes = calls.filter(_in("method", DB_WRITE) + " AND awaited AND fn >= 0")
    made = f.filter("kind = 'assign' AND fn >= 0 AND value RLIKE '^await .*[.](create|insert|insertOne|save|upsert)[(]'").select(*handler, F.regexp_extract("name", r"(\w+)$", 1).alias("_made"), F.col("post").alias("_end"))
    later = writes.join(made, handler).filter("_end < pre AND array_contains(idents, _made)").dropDuplicates(["norm_path", "pre"])
    missing("no-untransacted-dependent-writes", later, "kind = 'call' AND method IN ('$transaction', 'transaction')")
    # names that a module and its functions share
    shared = f.filter("kind = 'assign' AND fn = -1 AND literals['declared'] = 'let'").select("norm_path", "name").distinct()
    out.append(("no-cross-request-state-mutation", f.filter(f"kind = 'assign' AND fn >= 0 AND literals['declared'] = '' AND {HANDLER}").join(shared, ["norm_path", "name"], "left_semi")))
    functions = f.filter("kind = 'function' AND coalesce(name, '') <> ''")
    asynchronous = functions.filter("value = 'async'").select("norm_path", "name").distinct()
    out.append(("no-floating-promise", calls.filter("discarded AND NOT awaited AND NOT handled").join(asynchronous, ["norm_path", "name"], "left_semi")))
    started = f.filter("kind = 'function' AND value = 'async'").select("norm_path", F.col("pre").alias("_pre"))
    iife = calls.filter("coalesce(name, '') = '' AND discarded AND NOT handled AND NOT in_try").join(started, "norm_path").filter("_pre BETWEEN pre AND pre + 1")
    guarded_body = f.filter("kind = 'try'").select("norm_path", F.col("pre").alias("_try"))
    out.append(("no-missing-catch-on-async-iife", iife.join(guarded_body, (iife.norm_path == guarded_body.norm_path) & (F.col("_try") > F.col("pre")) & (F.col("_try") < F.col("post")), "left_anti")))
    # routes below a path that a middleware guards by its exact name only
    mounts = calls.filter("method = 'use' AND root = 'app' AND get(args, 0) LIKE '/%' AND NOT get(args, 0) LIKE '%*%' AND size(args) > 1").withColumn("_mount", F.get("args", F.lit(0)))
    below = calls.filter("method IN ('get', 'post', 'put', 'patch', 'delete') AND root = 'app' AND get(args, 0) LIKE '/%'").select("norm_path", F.get("args", F.lit(0)).alias("_path"))
    hono = mounts.join(files("kind = 'import' AND name = 'hono'"), "norm_path", "left_semi")
    out.append(("no-hono-exact-path-middleware", hono.join(below, "norm_path").filter("startswith(_path, concat(_mount, '/'))").dropDuplicates(["norm_path", "pre"])))
    # model output that reaches a dangerous call, and agent loops without a bound
    answers = f.filter("kind = 'assign' AND " + _re("value", r"^await\s+" + LLM_CALLS.replace("$", r"\("))).select("norm_path", F.regexp_extract("name", r"(\w+)$", 1).alias("_answer")).distinct()
    sinks = f.filter("kind IN ('call', 'new') AND (name IN ('eval', 'Function', 'exec', 'execSync') OR method IN ('exec', 'execSync', 'query', 'raw'))")
    out.append(("no-llm-output-in-sink", sinks.join(answers, "norm_path").filter("array_contains(idents, _answer)").dropDuplicates(["norm_path", "pre"])))
    endless = f.filter("kind = 'loop' AND " + _re("value", r"^while\s*\(\s*(true|1)\s*\)|^for\s*\(\s*;\s*;\s*\)") + " AND NOT array_contains(idents, 'break') AND NOT array_contains(idents, 'return')")
    models = calls.filter(_re("name", LLM_CALLS)).select("norm_path", F.col("pre").alias("_call"))
    out.append(("no-unbounded-agent-loop", endless.join(models, "norm_path").filter("pre <= _call AND _call <= post").dropDuplicates(["norm_path", "pre"])))
    # caller input handed to a helper of the file, whose parameter reaches a sink
    given = calls.select(*place, "line", "col", "name", F.posexplode("args").alias("_k", "_arg")).filter(_re("_arg", TAINT))
    helpers = functions.select("norm_path", "name", F.col("pre").alias("_lo"), F.col("post").alias("_hi"), F.posexplode("args").alias("_k", "_param"))
    dangerous = f.filter("kind IN ('call', 'new') AND (name IN ('eval', 'Function', 'exec', 'execSync') OR method IN ('exec', 'execSync', 'query', 'raw', '$queryRawUnsafe'))").select("norm_path", F.col("pre").alias("_sink"), F.col("idents").alias("_used"))
    reached = given.join(helpers, ["norm_path", "name", "_k"]).join(dangerous, "norm_path").filter("_lo < _sink AND _sink < _hi AND array_contains(_used, _param)")
    out.append(("no-tainted-sink-via-helper", reached.dropDuplicates(["norm_path", "pre"])))
    return out


def call_edges(facts: DataFrame) -> DataFrame:
    """(file, src, dst): which function (its first token) calls which function of its file, by name."""
    f = facts.filter("kind = 'function'").select("file", F.row_number().over(Window.partitionBy("file").orderBy("pre", F.desc("post"))).alias("_n"), F.col("pre").alias("dst"), "name")
    calls = facts.filter("kind = 'call' AND fn >= 0").select("file", (F.col("fn") + 1).alias("_n"), "name")
    callers = f.select("file", "_n", F.col("dst").alias("src"))
    return calls.join(f.filter("coalesce(name, '') <> ''").select("file", "name", "dst"), ["file", "name"]).join(callers, ["file", "_n"]).select("file", "src", "dst").distinct()


def reachable_sync_io(facts: DataFrame) -> DataFrame:
    """(norm_path, line, col, diagnostic) of blocking calls in functions that a request handler reaches through calls."""
    from factloom.operators import graph

    key = lambda c: F.concat_ws("#", "file", c)
    edges = call_edges(facts).select(key("src").alias("src"), key("dst").alias("dst"))
    handler = facts.filter("kind = 'function' AND exists(args, p -> p IN ('req', 'request', 'ctx'))").select(key("pre").alias("node")).distinct()
    reached = graph.reach(graph.clean_edges(edges), handler).filter("depth > 0").select("node")
    owner = facts.filter("kind = 'function'").select("file", F.row_number().over(Window.partitionBy("file").orderBy("pre", F.desc("post"))).alias("_n"), key("pre").alias("node"))
    calls = facts.filter(f"kind = 'call' AND {_in('method', SYNC_IO)} AND fn >= 0").withColumn("_n", F.col("fn") + 1).join(owner, ["file", "_n"])
    return calls.join(reached, "node", "left_semi").join(handler, "node", "left_anti").select(F.col("file").alias("norm_path"), "line", "col", F.lit("no-sync-io-reachable-from-handler").alias("diagnostic"))


def circular_imports(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(norm_path, line, col, diagnostic) of imports whose target reaches the importing file."""
    from factloom.operators import graph

    edges = import_edges(facts, files)
    ring = graph.strong_components(edges)
    inside = edges.join(ring.select(F.col("node").alias("src"), F.col("component").alias("_a")), "src").join(ring.select(F.col("node").alias("dst"), F.col("component").alias("_b")), "dst").filter("_a = _b")
    first = facts.filter("kind = 'import' AND value <> 'type' AND name LIKE '.%'").groupBy(F.col("file").alias("src")).agg(F.min(F.struct("line", "col")).alias("at"))
    return inside.select("src").distinct().join(first, "src").select(F.col("src").alias("norm_path"), "at.line", "at.col", F.lit("no-circular-imports").alias("diagnostic"))


def import_edges(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst) between files: relative imports resolved by candidate names, the first that exists."""
    i = facts.filter("kind = 'import' AND value <> 'type' AND name LIKE '.%'").select(F.col("file").alias("src"), F.col("name").alias("spec")).distinct()
    base = F.regexp_replace("src", r"[^/]*$", "")
    raw = F.concat(base, "spec")
    parts = F.aggregate(F.split(raw, "/"), F.array().cast("array<string>"), lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    stem = F.array_join(parts, "/")
    tails = ["", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.js"]
    tries = F.array(*[F.struct(F.lit(k).alias("rank"), F.concat(F.col("stem"), F.lit(t)).alias("dst")) for k, t in enumerate(tails)], F.struct(F.lit(len(tails)).alias("rank"), F.regexp_replace("stem", r"\.js$", ".ts").alias("dst")))
    j = i.withColumn("stem", stem).select("src", "spec", F.explode(tries).alias("x")).select("src", "spec", "x.*").join(files.select(F.col("path").alias("dst")).distinct(), "dst")
    return j.groupBy("src", "spec").agg(F.min_by("dst", "rank").alias("dst")).filter("src <> dst").select("src", "dst").distinct()


def directives(facts: DataFrame) -> DataFrame:
    """Inline suppressions (norm_path, line, kind, diagnostic)."""
    return facts.filter("kind LIKE 'directive:%'").select(F.col("file").alias("norm_path"), "line", F.expr("substring(kind, 11)").alias("kind"), F.col("name").alias("diagnostic"))


def parse_failures(facts: DataFrame) -> DataFrame:
    return facts.filter("kind = 'parse_error'").select(F.col("file").alias("norm_path"), F.col("value").alias("reason"))
