"""A SQL front end: PostgreSQL spellings rewritten, token by token, to Spark SQL.

Engine.execute takes one statement.  Queries give a DataFrame; statements that change saved tables are those of `statements`
and give the rows they return, or a tag.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .functions import strings
from .operators import select
from .session import configure
from .sources import catalog
from .statements import Statements

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<body>\$(?P<tag>\w*)\$.*?\$(?P=tag)\$)|(?P<text>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*"|`[^`]*`)
    |(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<word>[A-Za-z_]\w*)|(?P<param>\$\d+)|(?P<op>->>|->|::|<=|>=|<>|!=|\|\||.)""",
    re.S | re.X,
)
#: White space that trim takes off, as the function of `functions` does.
SPACES = strings.SPACES.translate({i: f"\\u{i:04x}" for i in range(32)})
#: Type names after :: and in CAST.
TYPES = {
    "TEXT": "STRING", "BYTEA": "BINARY", "INT4": "INT", "INT8": "BIGINT", "FLOAT4": "DOUBLE", "FLOAT8": "DOUBLE", "REAL": "DOUBLE", "FLOAT": "DOUBLE",
    "TIMESTAMP": "TIMESTAMP_NTZ", "TIMESTAMPTZ": "TIMESTAMP", "NUMERIC": "DECIMAL", "BOOL": "BOOLEAN", "JSON": "STRING", "JSONB": "STRING", "UUID": "STRING",
}
_END_OF_ORDER = {"LIMIT", "OFFSET", "FETCH", "ROWS", "RANGE", "GROUPS", "UNION", "EXCEPT", "INTERSECT", "WINDOW"}

#: Function calls by name: a format over the arguments {0}, {1}, ... and {all}.
CALLS = {
    "trim": "btrim({0}, {1})", "btrim": "btrim({0}, {1})", "bool": "CAST({0} AS BOOLEAN)", "boolean": "CAST({0} AS BOOLEAN)", "text": "CAST({0} AS STRING)", "integer": "CAST({0} AS INT)", "len": "CAST(length({0}) AS BIGINT)",
    "split_part": "CASE WHEN {0} IS NULL OR {2} IS NULL THEN NULL WHEN {2} < 1 THEN '' ELSE split_part({0}, {1}, greatest({2}, 1)) END",
    "strpos": "CAST(instr({0}, {1}) AS BIGINT)", "to_hex": "lower(hex({0}))", "starts_with": "startswith({all})", "ends_with": "endswith({all})",
    "iff": "if({0}, {1}, {2})", "concat": "concat_ws('', {all})", "length": "CAST(length({0}) AS BIGINT)", "char_length": "CAST(length({0}) AS BIGINT)", "character_length": "CAST(length({0}) AS BIGINT)",
    "ceil": "CAST(ceil(CAST({0} AS DOUBLE)) AS DOUBLE)", "ceiling": "CAST(ceil(CAST({0} AS DOUBLE)) AS DOUBLE)", "floor": "CAST(floor(CAST({0} AS DOUBLE)) AS DOUBLE)",
    "floor_div": "CAST(floor({0} / {1}) AS BIGINT)", "to_number": "CAST(trim({0}) AS DOUBLE)", "to_float": "CAST(trim({0}) AS DOUBLE)",
    "array_length": "CAST(array_size({0}) AS BIGINT)", "array_upper": "CAST(array_size({0}) AS BIGINT)", "array_lower": "1", "array_cat": "concat({all})", "array_prepend": "array_prepend({1}, {0})",
    "string_to_array": "split({0}, concat('\\\\Q', {1}, '\\\\E'), -1)", "unnest": "explode({0})", "gen_random_uuid": "uuid()", "uuid_generate_v4": "uuid()",
    "json_typeof": "CASE WHEN schema_of_variant(try_parse_json({0})) LIKE 'OBJECT%' THEN 'object' WHEN schema_of_variant(try_parse_json({0})) LIKE 'ARRAY%' THEN 'array' WHEN schema_of_variant(try_parse_json({0})) = 'STRING' THEN 'string' WHEN schema_of_variant(try_parse_json({0})) = 'BOOLEAN' THEN 'boolean' WHEN schema_of_variant(try_parse_json({0})) = 'VOID' THEN 'null' WHEN {0} IS NOT NULL THEN 'number' END",
    "json_build_object": "to_json(named_struct({all}), map('ignoreNullFields', 'false'))", "json_build_array": "to_json(array({all}), map('ignoreNullFields', 'false'))",
    "current_catalog": "current_catalog()", "int4": "CAST({0} AS INT)", "int8": "CAST({0} AS BIGINT)", "float8": "CAST({0} AS DOUBLE)",
}
_PARTS = {
    "dow": "dayofweek({0}) - 1", "isodow": "weekday({0}) + 1", "epoch": "unix_micros(CAST(CAST({0} AS TIMESTAMP_NTZ) AS TIMESTAMP)) / 1e6", "decade": "floor(year({0}) / 10)", "century": "floor((year({0}) - 1) / 100) + 1",
    "millennium": "floor((year({0}) - 1) / 1000) + 1", "milliseconds": "date_part('second', {0}) * 1e3", "microseconds": "date_part('second', {0}) * 1e6",
}
_TRUNCS = {"decade": "CAST(make_date(CAST(floor(year({0}) / 10) * 10 AS INT), 1, 1) AS TIMESTAMP_NTZ)", "century": "CAST(make_date(CAST(floor((year({0}) - 1) / 100) * 100 + 1 AS INT), 1, 1) AS TIMESTAMP_NTZ)"}


def tokens(sql: str) -> list[str]:
    """All tokens but space and comments; identifiers in double quotes come in backticks."""
    out = []
    for m in _TOKEN.finditer(sql):
        if m.lastgroup == "quoted" or m["quoted"]:
            out.append("`" + m["quoted"][1:-1].replace('""', '"') + "`")
        elif not m["space"]:
            out.append(m[0])
    return out


def _close(t: list[str], i: int) -> int:
    """Place of the bracket that closes the one at i."""
    depth = 0
    for j in range(i, len(t)):
        depth += t[j] in "([" and len(t[j]) == 1
        depth -= t[j] in ")]" and len(t[j]) == 1
        if not depth:
            return j
    raise ValueError("brackets don't match")


def _open(t: list[str], i: int) -> int:
    depth = 0
    for j in range(i, -1, -1):
        depth += t[j] in ")]" and len(t[j]) == 1
        depth -= t[j] in "([" and len(t[j]) == 1
        if not depth:
            return j
    raise ValueError("brackets don't match")


def _split(t: list[str], by: str = ",") -> list[list[str]]:
    parts, depth = [[]], 0
    for x in t:
        depth += x in ("(", "[")
        depth -= x in (")", "]")
        if x == by and not depth:
            parts.append([])
        else:
            parts[-1].append(x)
    return parts if parts != [[]] else []


def _operand(t: list[str]) -> int:
    """Start of the primary expression that ends the list."""
    i = len(t) - 1
    while i >= 0:
        if t[i] in (")", "]"):
            i = _open(t, i)
            if i and re.fullmatch(r"\w+|`.*`", t[i - 1]) and t[i - 1].upper() not in ("AND", "OR", "NOT", "SELECT", "WHERE", "ON", "WHEN", "THEN", "ELSE", "IN"):
                i -= 1
        if i > 1 and t[i - 1] == ".":
            i -= 2
            continue
        return i
    return 0


def _call(name: str, args: list[list[str]]) -> str | None:
    """The Spark SQL of a call that needs rewriting."""
    text = [" ".join(_rewrite(a)) for a in args]
    low = name.lower()
    if low.startswith("jsonb_"):
        low = "json_" + low[6:]
    if low == "log" and len(text) == 1:
        return f"log10({text[0]})"
    if low in ("trunc", "truncate") and text:
        scale = text[1] if len(text) > 1 else "0"
        return f"(sign({text[0]}) * floor(abs({text[0]}) * pow(10, {scale})) / pow(10, {scale}))"
    if low in ("ltrim", "rtrim") and len(text) == 2:
        return f"trim({'LEADING' if low == 'ltrim' else 'TRAILING'} {text[1]} FROM {text[0]})"
    if low in ("left", "right") and len(text) == 2:
        keep = f"if({text[1]} < 0, greatest(length({text[0]}) + {text[1]}, 0), least({text[1]}, length({text[0]})))"
        return f"substring({text[0]}, 1, {keep})" if low == "left" else f"substring({text[0]}, length({text[0]}) - {keep} + 1, {keep})"
    if low == "age" and text:
        a, b = (text if len(text) == 2 else ("localtimestamp()", text[0]))
        return f"CAST(timestampdiff(DAY, {b}, {a}) AS BIGINT)"
    if low in ("date_part", "extract") and text:
        if len(text) == 1:  # EXTRACT(field FROM x)
            words = args[0]
            at = next((i for i, w in enumerate(words) if w.upper() == "FROM"), None)
            if at is None:
                return None
            text = [f"'{words[0]}'", " ".join(_rewrite(words[at + 1 :]))]
        field = text[0].strip("'").lower()
        return f"CAST({_PARTS[field].format(text[1]) if field in _PARTS else f'date_part({chr(39)}{field}{chr(39)}, {text[1]})'} AS DOUBLE)"
    if low == "date_trunc" and len(text) == 2:
        unit = text[0].strip("'").lower()
        return _TRUNCS[unit].format(text[1]) if unit in _TRUNCS else f"CAST(date_trunc({text[0]}, {text[1]}) AS TIMESTAMP_NTZ)"
    if low in ("json_extract_path", "json_extract_path_text") and len(text) > 1:
        path = "$" + "".join(f"[{chr(39) * 2}{x[1:-1]}{chr(39) * 2}]" for x in text[1:])
        return f"get_json_object({text[0]}, '{path}')" if low.endswith("text") else f"to_json(try_variant_get(try_parse_json({text[0]}), '{path}', 'variant'))"
    if low == "position" and len(text) == 2:
        return f"CAST(instr({text[0]}, {text[1]}) AS BIGINT)"
    if low in ("trim", "btrim") and (len(text) == 1 and not any(w.upper() == "FROM" for w in args[0])):
        return f"btrim({text[0]}, '{SPACES}')"
    if low == "trim" and len(text) == 1:
        return None
    if low in ("substring", "substr") and len(text) > 1:
        return f"substring({text[0]}, greatest({text[1]}, 1){', ' + text[2] if len(text) > 2 else ''})"
    if low == "encode" and len(text) == 2 and text[1].strip("'").lower() in ("hex", "base64"):
        return f"lower(hex(CAST({text[0]} AS BINARY)))" if "hex" in text[1].lower() else f"base64(CAST({text[0]} AS BINARY))"
    if low in ("json_object",) and len(text) == 2:
        return f"to_json(map_from_arrays({text[0]}, {text[1]}))"
    if low in CALLS and (text or "{" not in CALLS[low]):
        return CALLS[low].format(*text, *[""] * 3, all=", ".join(text))
    return None


def _rewrite(t: list[str]) -> list[str]:
    out: list[str] = []
    i = 0
    while i < len(t):
        x, up = t[i], t[i].upper()
        following = t[i + 1] if i + 1 < len(t) else ""
        if x in ("->", "->>") and out:
            at = _operand(out)
            left, key = " ".join(out[at:]), following
            path = f"$[{key}]" if key.isdigit() else "$[" + chr(39) * 2 + key[1:-1] + chr(39) * 2 + "]"
            out[at:] = [f"get_json_object({left}, '{path}')" if x == "->>" else f"nullif(to_json(try_variant_get(try_parse_json({left}), '{path}', 'variant')), 'null')"]
            i += 2
        elif up == "GENERATE_SERIES" and following == "(":
            end = _close(t, i + 1)
            args = [" ".join(_rewrite(a)).replace("- ", "-") for a in _split(t[i + 2 : end])]
            if all(re.fullmatch(r"-?\d+", a) for a in args) and int((*args, 1)[2]):
                step = int((*args, 1)[2])
                out.append(f"(SELECT id AS generate_series FROM range({args[0]}, {int(args[1]) + (1 if step > 0 else -1)}, {step}))")
            else:  # one array for each row
                out.append(f"(SELECT explode(sequence({', '.join(f'CAST({a} AS BIGINT)' for a in args)})) AS generate_series)")
            i = end + 1
        elif up == "FETCH" and following.upper() in ("FIRST", "NEXT"):
            number = t[i + 2] if t[i + 2].isdigit() else "1"
            while t[i].upper() != "ONLY":
                i += 1
            out += ["LIMIT", number]
            i += 1
        elif up == "ORDER" and following.upper() == "BY":
            j, depth = i + 2, 0
            while j < len(t) and (depth or t[j] not in (")", ";") and t[j].upper() not in _END_OF_ORDER):
                depth += t[j] in ("(", "[")
                depth -= t[j] in (")", "]")
                j += 1
            keys = []
            for key in _split(t[i + 2 : j]):
                done = _rewrite(key)
                keys.append(" ".join(done if "NULLS" in [k.upper() for k in key] else [*done, "NULLS LAST"]))
            out += ["ORDER BY", ", ".join(keys)]
            i = j
        elif following == "(" and re.fullmatch(r"[A-Za-z_]\w*", x) and (call := _call(x, _split(t[i + 2 : (end := _close(t, i + 1))]))) is not None:
            out.append(call)
            i = end + 1
        elif (x == "::" or up == "AS" and _in_cast(out)) and following.upper() in TYPES:
            out += [x, TYPES[following.upper()] + ("(38, 10)" if following.upper() == "NUMERIC" and t[i + 2 : i + 3] != ["("] else "")]
            i += 2
        elif x == "[" and out and (re.fullmatch(r"\w+|`.*`|\)|.*\)", out[-1])) and out[-1].upper() != "ARRAY":
            end, at = _close(t, i), _operand(out)
            out[at:] = [f"get({' '.join(out[at:])}, {' '.join(_rewrite(t[i + 1 : end]))} - 1)"]
            i = end + 1
        elif up == "ARRAY" and following == "[":
            end = _close(t, i + 1)
            out.append(f"array({', '.join(' '.join(_rewrite(a)) for a in _split(t[i + 2 : end]))})")
            i = end + 1
        else:
            out.append(x)
            i += 1
    return out


def _in_cast(out: list[str]) -> bool:
    depth = 0
    for i in range(len(out) - 1, -1, -1):
        depth += out[i] == ")"
        if out[i] == "(":
            if not depth:
                return i > 0 and out[i - 1].upper() in ("CAST", "TRY_CAST")
            depth -= 1
    return False


def _distinct_on(t: list[str]) -> list[str]:
    """SELECT DISTINCT ON (keys) list FROM ... ORDER BY order [LIMIT n]: the first row of each key."""
    if [x.upper() for x in t[:3]] != ["SELECT", "DISTINCT", "ON"]:
        return t
    end = _close(t, 3)
    keys, rest = t[4:end], t[end + 1 :]
    at = next((i for i, x in enumerate(rest) if x.upper() == "FROM" and rest[:i].count("(") == rest[:i].count(")")), len(rest))
    order = next((i for i in range(len(rest) - 1, at, -1) if rest[i].upper() == "ORDER" and rest[i:].count("(") == rest[i:].count(")")), None)
    by = rest[order:] if order is not None else ["ORDER", "BY", *keys]
    cut = next((i for i, x in enumerate(by) if x.upper() in ("LIMIT", "OFFSET", "FETCH")), len(by))
    inner = ["SELECT", *rest[:at], ",", "row_number", "(", ")", "OVER", "(", "PARTITION", "BY", *keys, *by[:cut], ")", "AS", "__rn", *rest[at : order if order is not None else len(rest)]]
    return ["SELECT", "*", "EXCEPT", "(", "__rn", ")", "FROM", "(", *inner, ")", "WHERE", "__rn", "=", "1", *by[cut:]]


def translate(sql: str) -> str:
    """One query in Spark SQL."""
    return " ".join(_rewrite(_distinct_on([x for x in tokens(sql) if x != ";"]))).replace(" . ", ".")


def _kind(t: list[str]) -> str:
    """Spark's name of a type."""
    up = [x.upper() for x in t]
    if not t:
        raise ValueError("a column needs a type")
    if up[0] in ("VARCHAR", "CHAR", "CHARACTER"):
        return "STRING"
    if up[:2] == ["DOUBLE", "PRECISION"]:
        return "DOUBLE"
    array = t[-2:] == ["[", "]"]
    t, up = (t[:-2], up[:-2]) if array else (t, up)
    kind = "".join([TYPES.get(up[0], t[0]), *t[1:]]) + ("(38, 10)" if up == ["NUMERIC"] else "")
    return f"ARRAY<{kind}>" if array else kind


class NotSupported(Exception):
    """A statement that is refused, with its SQLSTATE."""

    def __init__(self, sqlstate: str, message: str):
        super().__init__(message)
        self.sqlstate = sqlstate

    def getSqlState(self) -> str:  # noqa: N802  as PySpark's own exceptions have it
        return self.sqlstate


#: Settings by their names in the dialect.
SETTINGS = {"timezone": "spark.sql.session.timeZone", "time zone": "spark.sql.session.timeZone"}


class Engine:
    """Executes statements in a session, with prepared statements of its own."""

    def __init__(self, spark: SparkSession):
        self.spark = configure(spark)
        self.prepared: dict[str, list[str]] = {}
        self.statements = Statements(self.spark, lambda t: " ".join(_rewrite(t)).replace(" . ", "."), _kind, self._query, _split, _close)

    def execute(self, sql: str) -> DataFrame:
        t = [x for x in tokens(sql) if x != ";"]
        up = [x.upper() for x in t]
        if up[:1] == ["PREPARE"]:
            at = up.index("AS")
            self.prepared[t[1]] = t[at + 1 :]
            return self._tag("PREPARE")
        if up[:1] == ["EXECUTE"]:
            args = _split(t[3 : _close(t, 2)]) if len(t) > 2 else []
            return self.execute(" ".join(" ".join(["(", *args[int(x[1:]) - 1], ")"]) if re.fullmatch(r"\$\d+", x) else x for x in self.prepared[t[1]]))
        if up[:1] == ["DEALLOCATE"]:
            self.prepared.pop(t[-1], None)
            return self._tag("DEALLOCATE")
        if up[:1] in (["ROLLBACK"], ["SAVEPOINT"], ["RELEASE"]):
            raise NotSupported("0A000", f"{up[0]}: changes are made at once and can't be taken back")
        if up[:1] in (["SET"], ["BEGIN"], ["COMMIT"], ["VACUUM"]) or up[:2] in (["START", "TRANSACTION"], ["CREATE", "INDEX"], ["DROP", "INDEX"]):
            return self._tag(up[0])
        if up[:1] == ["SHOW"]:
            return self.spark.createDataFrame([(self.spark.conf.get(SETTINGS.get(t[1].lower(), t[1]), None),)], f"`{t[1].lower()}` string")
        if up[:1] == ["ANALYZE"]:
            self.spark.sql(f"ANALYZE TABLE {t[1]} COMPUTE STATISTICS")
            return self._tag("ANALYZE")
        if up[:1] == ["EXPLAIN"]:
            plan = self.execute(" ".join(t[2:] if up[1] == "ANALYZE" else t[1:]))
            if up[1] == "ANALYZE":
                plan.write.format("noop").mode("overwrite").save()
            return self.spark.createDataFrame([(x,) for x in plan._jdf.queryExecution().toString().splitlines()], "plan string")
        if "FUNCTION" in up[:4] and up[0] in ("CREATE", "DROP"):
            return self._function(t, up)
        done = {
            ("CREATE", "TABLE"): self.statements.create_table, ("ALTER", "TABLE"): self.statements.alter, ("CREATE", "SEQUENCE"): self.statements.create_sequence,
            ("INSERT", "INTO"): self.statements.insert, ("DELETE", "FROM"): self.statements.change,
        }.get(tuple(up[:2])) or {"UPDATE": self.statements.change, "COPY": self.statements.copy}.get(up[0] if up else "")
        if done is not None:
            t = self._numbered(t) if up[0] == "INSERT" else t
            rows = done(t, [x.upper() for x in t])
            return self._tag(" ".join(up[:2]) if up[0] in ("CREATE", "ALTER") else up[0]) if rows is None else rows
        if up[:2] == ["DROP", "SEQUENCE"]:
            return self.spark.sql(f"DROP TABLE {'IF EXISTS ' if 'EXISTS' in up else ''}sequence_{t[-1]}")
        if up[:2] == ["WITH", "RECURSIVE"] and (found := self._recursive(t, up)) is not None:
            return found
        return self._query(self._numbered(t))

    def _query(self, t: list[str]) -> DataFrame:
        depth = 0
        for i, w in enumerate(t):  # UNION [ALL] BY NAME, for which Spark has no syntax
            depth += (w in ("(", "[")) - (w in (")", "]"))
            every = i + 1 < len(t) and t[i + 1].upper() == "ALL"
            if not depth and w.upper() == "UNION" and [x.upper() for x in t[i + 1 + every : i + 3 + every]] == ["BY", "NAME"]:
                both = self._query(t[:i]).unionByName(self._query(t[i + 3 + every :]), allowMissingColumns=True)
                return both if every else both.distinct()
        names = {f"information_schema.{n.removeprefix('information_schema_')}": n for n in catalog.VIEWS if n.startswith("information_schema_")}
        out = " ".join(_rewrite(_distinct_on(t)))
        words = tokens(out)
        low = [w.lower() for w in words]
        used: list[str] = []
        for i, w in enumerate(low):
            if w in ("information_schema", "pg_catalog") and low[i + 1 : i + 2] == ["."]:
                name = names.get(f"{w}.{low[i + 2]}", low[i + 2])
                if name in catalog.VIEWS:
                    words[i : i + 3] = low[i : i + 3] = [name, "", ""]
                    used.append(name)
            elif w in catalog.VIEWS and low[i - 1 : i] != ["."]:
                used.append(w)
        if used:
            catalog.register(self.spark, used)
            out = " ".join(w for w in words if w)
        return self.spark.sql(out.replace(" . ", "."))

    def _numbered(self, t: list[str]) -> list[str]:
        """Calls of sequences by their numbers, one for each place at which they stand."""
        out, i = [], 0
        while i < len(t):
            if t[i].lower() in ("nextval", "currval", "setval") and t[i + 1 : i + 2] == ["("]:
                end = _close(t, i + 1)
                args = ["".join(a) for a in _split(t[i + 2 : end])]
                more = [int(args[1]), *[a.lower() == "true" for a in args[2:]]] if len(args) > 1 else []
                out += ["CAST", "(", str(self.statements.sequence_call(t[i].lower(), args[0].strip("'"), *more)), "AS", "BIGINT", ")"]
                i = end + 1
            else:
                out.append(t[i])
                i += 1
        return out

    def _recursive(self, t: list[str], up: list[str]) -> DataFrame | None:
        """WITH RECURSIVE name [(columns)] AS (base UNION step) query, which Spark has for UNION ALL only; None if it is something else."""
        at, columns = 3, None
        if t[3] == "(":
            at = _close(t, 3) + 1
            columns = [c[0] for c in _split(t[4 : at - 1])]
        end = _close(t, at + 1)
        body = t[at + 2 : end]
        depth = 0
        for i, w in enumerate(body):
            depth += (w == "(") - (w == ")")
            if not depth and w.upper() == "UNION":
                if body[i + 1].upper() == "ALL" or t[end + 1 : end + 2] == [","]:
                    return None
                base = self._query(body[:i])
                base = base.toDF(*columns) if columns else base

                def step(new: DataFrame) -> DataFrame:
                    new.createOrReplaceTempView(t[2])
                    return self._query(body[i + 1 :])  # noqa: B023

                select.recursive(base, step).createOrReplaceTempView(t[2])
                return self._query(t[end + 1 :])
        return None

    def _tag(self, tag: str) -> DataFrame:
        return self.spark.createDataFrame([(tag,)], "command string")

    def _function(self, t: list[str], up: list[str]) -> DataFrame:
        """CREATE [OR REPLACE] FUNCTION f(...) RETURNS type LANGUAGE sql AS $$ SELECT ... $$ | RETURN expr, and DROP FUNCTION: inlined by the optimizer."""
        if up[0] == "DROP":
            return self.spark.sql("DROP TEMPORARY FUNCTION " + ("IF EXISTS " if "EXISTS" in up else "") + next(x for x, u in zip(t[2:], up[2:]) if u not in ("IF", "EXISTS")))
        at = up.index("FUNCTION") + 1
        end = _close(t, at + 1)
        params = ", ".join(" ".join([p[0], *[TYPES.get(x.upper(), x) for x in p[1:]]]) for p in _split(t[at + 2 : end]))
        returns = TYPES.get(up[up.index("RETURNS") + 1], t[up.index("RETURNS") + 1])
        if "RETURN" in up:
            body = " ".join(t[up.index("RETURN") + 1 :])
        else:
            body = re.fullmatch(r"\$(\w*)\$(.*)\$\1\$|'(.*)'", next(x for x in t if x.startswith(("$$", "$")) or x.startswith("'")), re.S)
            body = "(" + (body[2] or body[3]).strip().rstrip(";") + ")"
        names = [p[0] for p in _split(t[at + 2 : end])]
        body = " ".join(names[int(x[1:]) - 1] if re.fullmatch(r"\$\d+", x) else x for x in tokens(body))
        return self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {t[at]}({params}) RETURNS {returns} RETURN {translate(body)}")
