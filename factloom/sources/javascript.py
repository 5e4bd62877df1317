"""Facts of JavaScript and TypeScript texts: one table of calls, imports, functions, properties, assignments and the like.

A tokenizer and a bracket pass in Python (one mapInPandas stage over whole texts) find structure; everything after it is
DataFrame work. It is not a full parser: template holes are not descended into, types are skipped as they come. A text
whose brackets do not match, or that nests deeper than MAX_DEPTH, gives one fact of the kind parse_error.
"""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 1500
FACT = (
    "file string, kind string, name string, root string, method string, args array<string>, arg_kinds array<string>, keys array<string>, literals map<string,string>, "
    "value string, line int, col int, pre int, post int, fn int, fn_name string, fn_async boolean, fn_params array<string>, in_loop boolean, in_try boolean, in_catch boolean, in_finally boolean, "
    "catch_param string, awaited boolean, discarded boolean, handled boolean, interpolated boolean, idents array<string>"
)
NAMES = [x.strip().split(" ")[0] for x in re.split(r", (?=\w+ )", FACT)]
TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
    |(?P<number>0[xX][\da-fA-F_]+n?|\d[\d_]*(?:\.[\d_]+)?(?:[eE][+-]?\d+)?n?|\.\d+)|(?P<ident>[A-Za-z_$\#@][\w$]*)
    |(?P<punct>=>|\.\.\.|\?\.(?!\d)|[=!]==?|<=|>=|&&=?|\|\|=?|\?\?=?|\+\+|--|[-+*/%]=|[{}()\[\];,<>+\-*/%&|^!~?:=.])|(?P<other>.)""",
    re.X | re.S,
)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
KEYWORDS = frozenset("if for while switch catch function return typeof await new in of do else case throw void delete yield with import export class extends super instanceof".split())
BEFORE_VALUE = frozenset("return typeof case in of do else void delete throw new await yield instanceof".split())
LOOP_METHODS = frozenset("map forEach filter reduce some every flatMap find".split())
DIRECTIVE = re.compile(r"factloom-(disable-next-line|disable-line|disable|enable)(?:\s+([\w*/-]+))?")


def tokens_of(text: str) -> tuple[list[tuple[str, str, int]], list[tuple[str, int]]]:
    """((kind, text, offset) of significant tokens, (text, offset) of comments)."""
    out, comments, i, n = [], [], 0, len(text)
    while i < n:
        c = text[i]
        if c == "`":
            j, depth = i + 1, 0
            while j < n and not (text[j] == "`" and depth == 0):
                if text[j] == "\\":
                    j += 1
                elif text.startswith("${", j):
                    depth, j = depth + 1, j + 1
                elif text[j] == "}" and depth:
                    depth -= 1
                j += 1
            out.append(("template", text[i : j + 1], i))
            i = j + 1
            continue
        if c == "/" and not (out and (out[-1][0] in ("number", "string", "template", "regex") or out[-1][1] in (")", "]", "}") or (out[-1][0] == "ident" and out[-1][1] not in BEFORE_VALUE))):
            m = REGEX.match(text, i)
            if m:
                out.append(("regex", m.group(), i))
                i = m.end()
                continue
        m = TOKEN.match(text, i)
        if m.lastgroup == "comment":
            comments.append((m.group(), i))
        elif m.lastgroup != "space":
            out.append((m.lastgroup, m.group(), i))
        i = m.end()
    return out, comments


BRANCHES = frozenset(("if", "for", "while", "case", "catch", "&&", "||", "??", "?"))
CONTROL = frozenset(("if", "else", "for", "while", "do", "switch", "try", "catch"))
"""Tokens that add a path through a function, and those that may open a block of control flow."""


def unquoted(token: str) -> str:
    return token[1:-1] if token[:1] in "\"'`" else token


class Source:
    """Structure of one text."""

    def __init__(self, text: str):
        self.text = text
        self.t, self.comments = tokens_of(text)
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.close: dict[int, int] = {}
        stack: list[int] = []
        pairs = {")": "(", "]": "[", "}": "{"}
        for i, (_, x, _) in enumerate(self.t):
            if x in ("(", "[", "{"):
                stack.append(i)
                if len(stack) > MAX_DEPTH:
                    raise ValueError("nesting too deep")
            elif x in pairs and self.t[i][0] == "punct":
                if not stack or self.t[stack[-1]][1] != pairs[x]:
                    raise ValueError("brackets do not match")
                self.close[stack.pop()] = i
        if stack:
            raise ValueError("brackets do not match")
        self.open = {b: a for a, b in self.close.items()}
        self.functions: list[dict] = []
        self.ranges: dict[str, list[tuple[int, int, str | None]]] = {"loop": [], "try": [], "catch": [], "finally": []}
        self._find_ranges()

    def x(self, i: int) -> str:
        return self.t[i][1] if 0 <= i < len(self.t) else ""

    def names(self, i: int) -> bool:
        """Can the token at i be the last part of a callee? A keyword can after a dot."""
        return self.t[i][0] == "ident" and (self.x(i) not in KEYWORDS - {"import", "super"} or self.x(i - 1) in (".", "?."))

    def place(self, i: int) -> tuple[int, int]:
        at = self.t[i][2]
        line = bisect.bisect_right(self.lines, at)
        return line, at - self.lines[line - 1] + 1

    def src(self, a: int, b: int) -> str:
        """Text of the tokens a..b-1."""
        return self.text[self.t[a][2] : self.t[b - 1][2] + len(self.t[b - 1][1])] if b > a else ""

    def _end_of_expression(self, i: int) -> int:
        while i < len(self.t):
            x = self.x(i)
            if x in (",", ";", ")", "]", "}"):
                return i
            i = self.close.get(i, i) + 1
        return i

    def _statement(self, i: int) -> tuple[int, int]:
        if self.x(i) == "{":
            return i, self.close[i]
        j = i
        while j < len(self.t) and self.x(j) != ";" and self.x(j) != "}":
            j = self.close.get(j, j) + 1
        return i - 1, j

    def _params(self, a: int, b: int) -> list[str]:
        out, i = [], a
        while i < b:
            k, x, _ = self.t[i]
            if x in ("{", "["):
                out += [self.x(j) for j in range(i + 1, self.close[i]) if self.t[j][0] == "ident" and self.x(j + 1) != ":"]
                i = self.close[i]
            elif k == "ident" and x not in ("public", "private", "readonly", "this", "async") and not x.startswith("@"):
                out.append(x)
                while i < b and self.x(i) != ",":
                    i = self.close.get(i, i) + 1
            i += 1
        return out

    def _assigned(self, i: int) -> str:
        """Name that the expression at i is given: name = ..., name: ..."""
        return self.x(i - 2) if self.x(i - 1) in ("=", ":") and self.t[i - 2][0] == "ident" else ""

    def _function(self, start: int, name: str, is_async: bool, params: list[str], lo: int, hi: int, block: bool) -> None:
        self.functions.append({"start": start, "name": name, "async": is_async, "params": params, "lo": lo, "hi": hi, "block": block})

    def _find_ranges(self) -> None:
        i, n = 0, len(self.t)
        while i < n:
            k, x, _ = self.t[i]
            if k == "ident":
                if x == "function":
                    j = i + 1 + (self.x(i + 1) == "*")
                    name = self.x(j) if self.t[j : j + 1] and self.t[j][0] == "ident" else ""
                    j += bool(name)
                    if self.x(j) == "(":
                        end = self.close[j]
                        body = next((b for b in range(end + 1, min(end + 40, n)) if self.x(b) in ("{", ";")), -1)
                        if body > 0 and self.x(body) == "{":
                            a = i - (self.x(i - 1) == "async")
                            self._function(a, name or self._assigned(a), a < i, self._params(j + 1, end), body, self.close[body], True)
                elif x in ("for", "while") and self.x(i + 1 + (self.x(i + 1) == "await")) == "(":
                    j = i + 1 + (self.x(i + 1) == "await")
                    if not (x == "while" and self.x(i - 1) == "}" and self.x(self.open.get(i - 1, 0) - 1) == "do"):
                        self.ranges["loop"].append((*self._statement(self.close[j] + 1), self.src(i, self.close[j] + 1)))
                elif x == "do" and self.x(i + 1) == "{":
                    self.ranges["loop"].append((i + 1, self.close[i + 1], "do"))
                elif x in ("try", "finally") and self.x(i + 1) == "{":
                    self.ranges[x].append((i + 1, self.close[i + 1], None))
                elif x == "catch" and self.x(i - 1) == "}":
                    if self.x(i + 1) == "(" and self.x(self.close[i + 1] + 1) == "{":
                        b = self.close[i + 1] + 1
                        self.ranges["catch"].append((b, self.close[b], self.x(i + 2)))
                    elif self.x(i + 1) == "{":
                        self.ranges["catch"].append((i + 1, self.close[i + 1], ""))
                elif x not in KEYWORDS and self.x(i + 1) == "(" and self.x(i - 1) in ("{", "}", ";", ",", "async", "static", "get", "set", "*", "public", "private"):
                    end = self.close[i + 1]
                    body = end + 1
                    if self.x(body) == ":":
                        body = next((b for b in range(body, min(body + 30, n)) if self.x(b) in ("{", ";", ",")), body)
                    if self.x(body) == "{":
                        self._function(i, x, self.x(i - 1) == "async", self._params(i + 2, end), body, self.close[body], True)
            elif x == "=>":
                if self.x(i - 1) == ")":
                    a = self.open[i - 1]
                    params = self._params(a + 1, i - 1)
                else:
                    a, params = i - 1, [self.x(i - 1)]
                is_async = self.x(a - 1) == "async"
                a -= is_async
                if self.x(i + 1) == "{":
                    self._function(a, self._assigned(a), is_async, params, i + 1, self.close[i + 1], True)
                else:
                    self._function(a, self._assigned(a), is_async, params, i, self._end_of_expression(i + 1), False)
            i += 1
        self.functions.sort(key=lambda f: (f["lo"], -f["hi"]))

    def kind_of(self, a: int, b: int) -> str:
        """What an expression of tokens a..b-1 looks like."""
        if b <= a:
            return "none"
        k, x, _ = self.t[a]
        if b == a + 1:
            return {"string": "string", "number": "number", "template": "template", "regex": "regex"}.get(k, "ident" if k == "ident" else "other")
        if x == "{" and self.close.get(a) == b - 1:
            return "object"
        if x == "[" and self.close.get(a) == b - 1:
            return "array"
        f = next((f for f in self.functions if f["start"] == a and f["hi"] >= b - 2), None)
        if f:
            return "async_function" if f["async"] else "function"
        if all(self.t[i][0] == "ident" or self.x(i) in (".", "?.") for i in range(a, b)):
            return "member"
        return "concat" if any(self.x(i) == "+" for i in range(a, b)) else "other"

    def pieces(self, a: int, b: int) -> list[tuple[int, int]]:
        """Comma-separated parts of the tokens a..b-1."""
        out, i, first = [], a, a
        while i < b:
            if self.x(i) == ",":
                out.append((first, i))
                first = i + 1
            i = self.close.get(i, i) + 1
        if first < b:
            out.append((first, b))
        return out

    def pairs(self, brace: int) -> list[tuple[str, int, int, int]]:
        """(key, place, value from, to) of an object literal."""
        out = []
        for a, b in self.pieces(brace + 1, self.close[brace]):
            a += self.x(a) == "async"
            key = unquoted(self.x(a)) if self.t[a][0] in ("ident", "string") else None
            if self.x(a) == "...":
                out.append(("...", a, a + 1, b))
            elif key is not None:
                out.append((key, a, a + 2, b) if self.x(a + 1) == ":" else (key, a, a, b))
        return out


def facts_of(file: str, text: str) -> list[dict]:
    try:
        s = Source(text)
    except (ValueError, KeyError, IndexError) as e:
        return [{"file": file, "kind": "parse_error", "value": str(e)[:200], "line": 1, "col": 1, "pre": 0, "post": 0}]
    out: list[dict] = []

    def within(kind: str, i: int, lo: int, hi: int):
        """Innermost range that holds i and lies in the function lo..hi."""
        best = None
        for a, b, what in s.ranges[kind]:
            if a < i <= b and lo <= a and b <= hi and (best is None or a > best[0]):
                best = (a, b, what)
        return best

    def add(kind: str, i: int, end: int, **more) -> dict:
        line, col = s.place(i)
        own = [k for k, f in enumerate(s.functions) if f["lo"] < i <= f["hi"] and f["start"] != i]
        fn = own[-1] if own else -1
        f = s.functions[fn] if own else {"name": "", "async": False, "params": [], "lo": -1, "hi": len(s.t)}
        c = within("catch", i, f["lo"], f["hi"])
        row = {
            "file": file, "kind": kind, "line": line, "col": col, "pre": i, "post": end, "fn": fn, "fn_name": f["name"], "fn_async": bool(f["async"]), "fn_params": f["params"], "in_loop": within("loop", i, f["lo"], f["hi"]) is not None,
            "in_try": within("try", i, f["lo"], f["hi"]) is not None, "in_catch": c is not None, "catch_param": c[2] if c else None, "in_finally": within("finally", i, f["lo"], f["hi"]) is not None,
            "idents": sorted({s.x(j) for j in range(i, min(end + 1, len(s.t))) if s.t[j][0] == "ident"}),
        }
        out.append(row | more)
        return out[-1]

    def around(i: int, e: int) -> dict:
        """The tokens before a statement that begins at i and after one that ends before e."""
        return {"prev": s.x(i - 1), "next": s.x(e + 1 if s.x(e) == ";" else e)}

    inner = [{j for g in s.functions if f["lo"] < g["start"] and g["hi"] <= f["hi"] and g is not f for j in range(g["start"], g["hi"] + 1)} for f in s.functions]
    for f, apart in zip(s.functions, inner, strict=True):
        body = [s.x(j) for j in range(f["lo"] + 1, f["hi"])]
        own = [j for j in range(f["lo"] + 1, f["hi"]) if j not in apart]
        branches = sum(s.x(j) in BRANCHES and s.x(j - 1) != "." and not (s.x(j) == "?" and s.x(j + 1) in (":", ")", ",")) for j in own)
        deep, open_at = 0, []
        for j in own:  # blocks of control flow that hold each other
            while open_at and j > open_at[-1]:
                open_at.pop()
            if s.x(j) in CONTROL and s.x(j - 1) not in (".", "else"):
                k = j + 1
                if s.x(k) == "(":
                    k = s.close[k] + 1
                if s.x(k) == "{":
                    open_at.append(s.close[k])
                    deep = max(deep, len(open_at))
        awaits = any(s.x(j) == "await" for j in own)
        add("function", f["start"], f["hi"], name=f["name"], args=f["params"], value="async" if f["async"] else "", literals={"tokens": str(len(body)), "lines": str(s.place(min(f["hi"], len(s.t) - 1))[0] - s.place(f["start"])[0] + 1), "block": str(f["block"]).lower(), "complexity": str(1 + branches), "depth": str(deep), "awaits": str(awaits).lower()})
    for kind in ("loop", "catch", "finally", "try"):
        for a, b, what in s.ranges[kind]:
            add(kind, max(a, 0), min(b, len(s.t) - 1), value=what, literals={"tokens": str(b - a - 1)})
    n, i = len(s.t), 0
    while i < n:
        k, x, _ = s.t[i]
        if x == "import" and s.x(i + 1) not in ("(", "."):
            j = next((j for j in range(i + 1, n) if s.t[j][0] == "string" or s.x(j) == ";"), n)
            if j < n and s.t[j][0] == "string":
                names = [s.x(q) for q in range(i + 1, j) if s.t[q][0] == "ident" and s.x(q) not in ("from", "as", "type")]
                add("import", i, j, name=unquoted(s.x(j)), args=names, value="type" if s.x(i + 1) == "type" else "namespace" if s.x(i + 1) == "*" else "esm")
                i = j
        elif x == "(" and k == "punct" and i and (s.names(i - 1) or s.x(i - 1) in (")", "]")) and not any(f["start"] in (i - 1, i) and f["lo"] > i for f in s.functions):
            j = i - 1
            chain: list[str] = []
            while True:
                if s.names(j):
                    chain.append(s.x(j))
                    if s.x(j - 1) in (".", "?."):
                        j -= 2
                        continue
                elif s.x(j) in (")", "]"):
                    chain.append("")
                    j = s.open[j]
                    if s.t[j - 1][0] == "ident" and s.x(j - 1) not in KEYWORDS or s.x(j - 1) in (")", "]"):
                        j -= 1
                        chain.pop()
                        if s.t[j][0] == "ident":
                            chain.append(s.x(j) + "()")
                            if s.x(j - 1) in (".", "?."):
                                j -= 2
                                continue
                        else:
                            continue
                else:
                    j += 1
                break
            j = max(j, 0)
            chain = chain[::-1]
            new = s.x(j - 1) == "new"
            head = j - new
            awaited = s.x(head - 1) == "await"
            head -= awaited
            end = s.close[i]
            before, after = s.x(head - 1), s.x(end + 1)
            ends = end + 1 >= n or after in (";", "}") or (s.place(end + 1)[0] > s.place(end)[0] and after not in (".", "?.", "(", "[", "`", "+", "-", "*", "/", ",", "?", ":", "&&", "||", "=", ")"))
            starts = head == 0 or before in (";", "{", "}") or (before == ")" and s.place(head)[0] > s.place(head - 1)[0]) or (s.place(head)[0] > s.place(head - 1)[0] and before not in (".", "?.", ",", "(", "[", "=", "=>", "+", "&&", "||", "?", ":", "return"))
            parts = s.pieces(i + 1, end)
            literals, keys = {}, []
            for a, b in parts:
                if s.x(a) == "{" and s.close.get(a) == b - 1:
                    for key, _, va, vb in s.pairs(a):
                        keys.append(key)
                        literals[key] = unquoted(s.x(va)) if vb == va + 1 and s.t[va][0] in ("string", "number", "ident") else s.src(va, vb)
            first = parts[0] if parts else None
            inter = bool(first) and any("${" in s.x(q) if s.t[q][0] == "template" else s.x(q) == "+" and (s.t[q - 1][0] in ("string", "template") or s.t[q + 1][0] in ("string", "template")) for q in range(*first))
            add(
                "new" if new else "call", j, end, name=".".join(c for c in chain if c), root=chain[0] if chain else "", method=chain[-1] if chain else "", args=[unquoted(s.src(a, b)) if b == a + 1 else s.src(a, b) for a, b in parts],
                arg_kinds=[s.kind_of(a, b) for a, b in parts], keys=keys, literals=literals, awaited=awaited, discarded=bool(starts and ends), handled=after in (".", "?.") and s.x(end + 2) in ("then", "catch", "finally"), interpolated=inter,
                value=before if before in ("return", "=", "=>", "void", "throw") else "",
            )
            if s.x(j) == "require" and parts and s.t[parts[0][0]][0] == "string":
                add("import", j, end, name=unquoted(s.x(parts[0][0])), args=[s._assigned(head)] if s._assigned(head) else [], value="require")
        elif x == "{" and s.x(i - 1) in ("(", "=", ":", ",", "[", "return", "=>", "?") and k == "punct":
            for key, at, a, b in s.pairs(i):
                if a > at and b > a:
                    add("prop", at, b - 1, name=key, value=unquoted(s.src(a, b)) if b == a + 1 else s.src(a, b), arg_kinds=[s.kind_of(a, b)])
        elif x in ("=", "+=", "||=", "??=") and s.t[i - 1][0] == "ident":
            j = i - 1
            while s.x(j - 1) in (".", "?.") and s.t[j - 2][0] == "ident":
                j -= 2
            e = s._end_of_expression(i + 1)
            word = s.x(j - 1)
            value = s.src(i + 1, e)
            add("assign", j, max(e - 1, i), name=s.src(j, i), root=s.x(j), method=x, value=unquoted(value) if e == i + 2 else value, arg_kinds=[s.kind_of(i + 1, e)], literals={"declared": word if word in ("const", "let", "var") else ""})
        elif x == "throw":
            e = s._end_of_expression(i + 1)
            add("throw", i, e - 1, value=s.src(i + 1, e), arg_kinds=[s.kind_of(i + 1, e)], literals=around(i, e))
        elif x in ("==", "===", "!=", "!==", "<", ">", "<=", ">="):
            add("compare", i, i, name=x, args=[s.x(i - 1), s.x(i + 1)])
        elif k == "ident" and x == "return":
            e = s._end_of_expression(i + 1)
            add("return", i, max(e - 1, i), value=s.src(i + 1, e) if e > i + 1 else "", literals=around(i, e))
        elif k == "ident" and s.x(i + 1) in (".", "?.") and s.x(i - 1) not in (".", "?."):
            j = i
            while s.x(j + 1) in (".", "?.") and s.t[j + 2 : j + 3] and s.t[j + 2][0] == "ident":
                j += 2
            if s.x(j + 1) != "(" and j > i:
                add("member", i, j, name=s.src(i, j + 1), root=x, method=s.x(j))
        elif k == "ident" and x in ("__dirname", "__filename") and s.x(i - 1) not in (".", "const", "let", "var"):
            add("ident", i, i, name=x)
        elif k == "regex":
            add("regex", i, i, value=x)
        i += 1
    for c, at in s.comments:
        line = bisect.bisect_right(s.lines, at)
        m = DIRECTIVE.search(c)
        kind = {"disable-next-line": "next", "disable-line": "same", "disable": "disable", "enable": "enable"}[m[1]] if m else "comment"
        out.append({"file": file, "kind": f"directive:{kind}" if m else "comment", "name": (m[2] or "*") if m else None, "value": c, "line": line, "col": at - s.lines[line - 1] + 1, "pre": -1, "post": -1, "fn": -1})
    return out


def facts(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Facts of all texts; one stage, one row per fact."""

    def run(batches):
        for b in batches:
            rows = [r for p, t in zip(b["p"], b["t"], strict=True) for r in facts_of(p, t or "")]
            yield pd.DataFrame([[r.get(c) for c in NAMES] for r in rows], columns=NAMES, dtype=object)

    return texts.select(F.col(path).alias("p"), F.col(text).alias("t")).mapInPandas(run, FACT)
