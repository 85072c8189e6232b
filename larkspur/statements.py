"""Statements that change saved tables, with declared constraints: CREATE TABLE, INSERT, UPDATE, DELETE, ALTER TABLE, COPY and sequences.

What a table declares is kept as JSON among its properties, so it lasts as long as the table.  Each statement works out the
new rows as a DataFrame, has the constraints checked on them, and then appends them or puts the new table in the old one's place.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.checkpoints import cut
from .operators.constraints import Constraints, ConstraintViolation
from .sources import files, sequences, tables

Tokens = list[str]
_CLAUSES = {"PRIMARY", "NOT", "NULL", "UNIQUE", "DEFAULT", "CHECK", "REFERENCES", "CONSTRAINT"}
_ACTIONS = {"CASCADE": "cascade", "SET NULL": "set null", "SET DEFAULT": "set default", "RESTRICT": "restrict", "NO ACTION": "restrict"}


def empty_meta() -> dict:
    return {"not_null": [], "defaults": {}, "serial": {}, "unique": [], "primary": [], "checks": {}, "foreign": []}


class Statements:
    """parse: rewrites tokens to Spark SQL.  kind: Spark's name of a type.  query: runs a query given as tokens."""

    def __init__(self, spark: SparkSession, parse: Callable[[Tokens], str], kind: Callable[[Tokens], str], query: Callable[[Tokens], DataFrame], split: Callable, close: Callable):
        self.spark, self.parse, self.kind, self.query, self.split, self.close = spark, parse, kind, query, split, close

    # What tables declare

    def meta(self, name: str) -> dict:
        found = {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        return empty_meta() | json.loads(found.get(tables.META, "{}"))

    def keep(self, name: str, meta: dict) -> None:
        text = json.dumps(meta, sort_keys=True).replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{tables.META}' = '{text}')")

    def children(self, name: str) -> list[tuple[str, dict, dict]]:
        out = []
        for t in self.spark.catalog.listTables():
            if not t.isTemporary:
                meta = self.meta(t.name)
                out += [(t.name, meta, f) for f in meta["foreign"] if f["parent"].lower() == name.lower()]
        return out

    def _constraints(self, meta: dict) -> Constraints:
        foreign = [(f["columns"], self.spark.table(f["parent"]), f["key"]) for f in meta["foreign"]]
        keys = [*([meta["primary"]] if meta["primary"] else []), *meta["unique"]]
        checks = {n: F.expr(e) for n, e in meta["checks"].items()}
        return Constraints([*meta["not_null"], *meta["primary"]], keys, checks, foreign)

    # Definition

    def _column(self, t: Tokens, meta: dict) -> str:
        """A column's definition; its constraints go to meta."""
        name, at = t[0], 1
        while at < len(t) and t[at].upper() not in _CLAUSES:
            at += 1
        kind = t[1:at]
        if kind and kind[0].upper() in ("SERIAL", "BIGSERIAL"):
            meta["serial"][name] = 1
            meta["not_null"].append(name)
            kind = ["INT" if kind[0].upper() == "SERIAL" else "BIGINT"]
        label = None
        while at < len(t):
            up = t[at].upper()
            if up == "CONSTRAINT":
                label, at = t[at + 1], at + 2
            elif up == "PRIMARY":
                meta["primary"], at = [name], at + 2
            elif up == "NOT":
                meta["not_null"].append(name)
                at += 2
            elif up == "NULL":
                at += 1
            elif up == "UNIQUE":
                meta["unique"].append([name])
                at += 1
            elif up == "DEFAULT":
                end = at + 1
                while end < len(t) and (end == at + 1 or t[end].upper() not in _CLAUSES):
                    end = self.close(t, end) + 1 if t[end] == "(" else end + 1
                meta["defaults"][name], at = self.parse(t[at + 1 : end]), end
            elif up == "CHECK":
                end = self.close(t, at + 1)
                meta["checks"][label or f"{name}_check"], at = self.parse(t[at + 2 : end]), end + 1
            elif up == "REFERENCES":
                at = self._references([name], t, at, meta, label)
            else:
                raise ValueError(f"unknown constraint {t[at]}")
        return f"{name} {self.kind(kind)}"

    def _references(self, columns: list[str], t: Tokens, at: int, meta: dict, label: str | None) -> int:
        found = {"columns": columns, "parent": t[at + 1], "key": [], "delete": "restrict", "update": "restrict", "name": label or f"{columns[0]}_fkey"}
        at += 2
        if at < len(t) and t[at] == "(":
            end = self.close(t, at)
            found["key"], at = [k[0] for k in self.split(t[at + 1 : end])], end + 1
        while at + 2 < len(t) and t[at].upper() == "ON":
            words = 1 if t[at + 2].upper() in ("CASCADE", "RESTRICT") else 2
            found[t[at + 1].lower()] = _ACTIONS[" ".join(t[at + 2 : at + 2 + words]).upper()]
            at += 2 + words
        found["key"] = found["key"] or self.meta(found["parent"])["primary"]
        meta["foreign"].append(found)
        return at

    def _table_constraint(self, t: Tokens, meta: dict) -> bool:
        """Whether t is a table's constraint, which goes to meta then."""
        label, rest = (t[1], t[2:]) if t[0].upper() == "CONSTRAINT" else (None, t)
        word = rest[0].upper()
        if word not in ("PRIMARY", "UNIQUE", "CHECK", "FOREIGN"):
            return False
        at = rest.index("(")
        end = self.close(rest, at)
        inner = rest[at + 1 : end]
        columns = [c[0] for c in self.split(inner)]
        if word == "PRIMARY":
            meta["primary"] = columns
        elif word == "UNIQUE":
            meta["unique"].append(columns)
        elif word == "CHECK":
            meta["checks"][label or f"check_{len(meta['checks']) + 1}"] = self.parse(inner)
        else:
            self._references(columns, rest, end + 1, meta, label)
        return True

    def create_table(self, t: Tokens, up: Tokens) -> None:
        there = up[2:5] == ["IF", "NOT", "EXISTS"]
        name, rest = (t[5], t[6:]) if there else (t[2], t[3:])
        if there and self.spark.catalog.tableExists(name):
            return
        if rest[:1] != ["("]:
            tables.create(self.spark, name, self.query(rest[1:]))  # CREATE TABLE ... AS
            return
        meta = empty_meta()
        parts = self.split(rest[1 : self.close(rest, 0)])
        columns = [self._column(p, meta) for p in parts if not self._table_constraint(p, meta)]
        self.spark.sql(f"CREATE TABLE {name} ({', '.join(columns)}) USING PARQUET")
        self.keep(name, meta)

    def alter(self, t: Tokens, up: Tokens) -> None:
        name, does = t[2], up[3]
        table, meta = self.spark.table(name), self.meta(name)
        words = [w for w in t[4:] if w.upper() != "COLUMN"]
        if does == "RENAME" and up[4] == "TO":
            self.spark.sql(f"ALTER TABLE {name} RENAME TO {t[5]}")
        elif does == "RENAME":
            old, new = words[0], words[2]
            swap = lambda x: new if x == old else x
            for k in ("not_null", "primary"):
                meta[k] = [swap(c) for c in meta[k]]
            meta["unique"] = [[swap(c) for c in u] for u in meta["unique"]]
            for k in ("defaults", "serial"):
                meta[k] = {swap(c): v for c, v in meta[k].items()}
            meta["checks"] = {n: re.sub(rf"\b{re.escape(old)}\b", new, e) for n, e in meta["checks"].items()}
            meta["foreign"] = [f | {"columns": [swap(c) for c in f["columns"]]} for f in meta["foreign"]]
            tables.replace(self.spark, name, tables.rename_column(table, old, new), meta)
        elif does == "ADD" and self._table_constraint(words, meta):
            self._constraints(meta).enforce(table)
            self.keep(name, meta)
        elif does == "ADD":
            words = words[3:] if words[0].upper() == "IF" else words
            column, kind = self._column(words, meta).split(" ", 1)
            default = F.expr(meta["defaults"][column]) if column in meta["defaults"] else F.lit(None)
            changed = table.withColumn(column, default.cast(kind))
            self._constraints(meta).enforce(changed)
            tables.replace(self.spark, name, changed, meta)
        elif does == "DROP" and words[0].upper() == "CONSTRAINT":
            label = words[-1]
            meta["checks"].pop(label, None)
            meta["foreign"] = [f for f in meta["foreign"] if f["name"] != label]
            self.keep(name, meta)
        elif does == "DROP":
            column = words[-1]
            for k in ("not_null", "primary"):
                meta[k] = [c for c in meta[k] if c != column]
            meta["unique"] = [u for u in meta["unique"] if column not in u]
            for k in ("defaults", "serial"):
                meta[k].pop(column, None)
            meta["foreign"] = [f for f in meta["foreign"] if column not in f["columns"]]
            tables.replace(self.spark, name, tables.drop_column(table, column), meta)
        elif does == "ALTER":
            column, rest = words[0], words[1:]
            what = " ".join(rest[:3]).upper()
            if what.startswith("SET NOT NULL"):
                meta["not_null"].append(column)
                self._constraints(meta).enforce(table)
            elif what.startswith("DROP NOT NULL"):
                meta["not_null"] = [c for c in meta["not_null"] if c != column]
            elif what.startswith("SET DEFAULT"):
                meta["defaults"][column] = self.parse(rest[2:])
            elif what.startswith("DROP DEFAULT"):
                meta["defaults"].pop(column, None)
            else:  # [SET DATA] TYPE kind
                at = [w.upper() for w in rest].index("TYPE") + 1
                tables.replace(self.spark, name, tables.change_type(table, column, self.kind(rest[at:])), meta)
                return
            self.keep(name, meta)
        else:
            raise ValueError(f"ALTER TABLE ... {does} isn't known")

    # Rows

    def _whole(self, given: DataFrame, columns: list[str], table: DataFrame, meta: dict, name: str) -> DataFrame:
        """Rows of all columns: those given, numbers of serial columns, defaults, or NULL."""
        if len(given.columns) != len(columns):
            raise ValueError(f"INSERT has {len(given.columns)} expressions but {len(columns)} target columns")
        rows = given.toDF(*columns)
        for c, start in meta["serial"].items():
            if c not in columns:
                own = sequences.Sequence(start)
                rows = sequences.number_rows(rows, c, own, columns)
                meta["serial"][c] = own.nextval()
                self.keep(name, meta)
        filled = {c: F.expr(e) for c, e in meta["defaults"].items()}
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else filled.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in table.schema.fields])

    def insert(self, t: Tokens, up: Tokens) -> DataFrame | None:
        name, table, meta = t[2], self.spark.table(t[2]), self.meta(t[2])
        at, columns = 3, list(table.columns)
        if t[3] == "(":
            end = self.close(t, 3)
            columns, at = [c[0] for c in self.split(t[4:end])], end + 1
        stop = lambda words: next((i for i in range(at, len(t)) if up[i : i + len(words)] == words), len(t))
        conflict, returning = stop(["ON", "CONFLICT"]), stop(["RETURNING"])
        body = t[at : min(conflict, returning)]
        if body[0].upper() == "VALUES":
            if columns == list(table.columns):
                columns = columns[: len(self.split(self.split(body[1:])[0][1:-1]))]
            rows = [[self.parse(x) if [w.upper() for w in x] != ["DEFAULT"] else f"({meta['defaults'].get(c, 'NULL')})" for c, x in zip(columns, self.split(r[1:-1]), strict=True)] for r in self.split(body[1:])]
            given = self.query(["VALUES", ", ".join(f"({', '.join(r)})" for r in rows)])
        else:
            given = self.query(body)
            columns = columns[: len(given.columns)] if columns == list(table.columns) else columns
        new = cut(self._whole(given, columns, table, meta, name))
        if conflict < len(t):
            return self._upsert(name, table, meta, new, t[conflict + 2 : returning], t[returning + 1 :])
        rules = self._constraints(meta)
        Constraints(rules.not_null, (), rules.checks, [f for f, k in zip(rules.foreign, meta["foreign"]) if k["parent"] != name]).enforce(new)
        if rules.unique or any(f["parent"] == name for f in meta["foreign"]):
            Constraints((), rules.unique, {}, [(f["columns"], table.unionByName(new), f["key"]) for f in meta["foreign"] if f["parent"] == name]).enforce(table.unionByName(new))
        new.write.insertInto(name)
        return self._returned(new, t[returning + 1 :])

    def _upsert(self, name: str, table: DataFrame, meta: dict, new: DataFrame, clause: Tokens, returning: Tokens) -> DataFrame | None:
        from .operators import dml

        at, key = 0, meta["primary"] or (meta["unique"] or [[]])[0]
        if clause[0] == "(":
            end = self.close(clause, 0)
            key, at = [c[0] for c in self.split(clause[1:end])], end + 1
        if not key:
            raise ValueError("ON CONFLICT needs a key")
        rest = clause[at + 1 :]  # after DO
        sets = {}
        if rest[0].upper() == "UPDATE":
            own = [rest[i] for i in range(len(rest)) if not (rest[i].lower() == name.lower() and rest[i + 1 : i + 2] == ["."] or rest[i] == "." and rest[i - 1].lower() == name.lower())]
            own = [w.lower() if w.upper() == "EXCLUDED" else w for w in own]
            where = next((i for i, w in enumerate(own) if w.upper() == "WHERE"), len(own))
            sets = {s[0]: F.expr(self.parse(s[2:])) for s in self.split(own[2:where])}
            if where < len(own):
                condition = F.expr(self.parse(own[where + 1 :]))
                sets = {c: F.when(condition, e).otherwise(F.col(c)) for c, e in sets.items()}
        result = cut(dml.upsert(table, new, key, sets or None))
        rules = self._constraints(meta)
        rules.enforce(result)
        touched = result.join(new.select(*key).distinct(), key, "left_semi") if sets else result.join(new.select(*key).distinct(), key, "left_semi").join(table.select(*key), key, "left_anti")
        touched = cut(touched) if returning else None
        tables.replace(self.spark, name, result, meta)
        return self._returned(touched, returning) if returning else None

    def _returned(self, rows: DataFrame, returning: Tokens) -> DataFrame | None:
        return rows.selectExpr(*[self.parse(r) for r in self.split(returning)]) if returning else None

    def change(self, t: Tokens, up: Tokens) -> DataFrame | None:
        """UPDATE t [AS a] SET ... [FROM ...] [WHERE ...] [RETURNING ...] and DELETE FROM t [AS a] [USING ...] [WHERE ...] [RETURNING ...].

        Of several rows of FROM that meet a row the one with the least new values counts.
        """
        deletes = up[0] == "DELETE"
        at = 2 if deletes else 1
        name, alias = t[at], t[at]
        if up[at + 1 : at + 2] == ["AS"]:
            alias = t[at + 2]
        elif at + 1 < len(t) and up[at + 1] not in ("SET", "USING", "WHERE", "RETURNING"):
            alias = t[at + 1]
        depth, marks = 0, {}
        for i, w in enumerate(up):
            depth += (w in ("(", "[")) - (w in (")", "]"))
            if not depth and w in ("SET", "FROM", "USING", "WHERE", "RETURNING") and i > at and w not in marks:
                marks[w] = i
        ends = sorted([*marks.values(), len(t)])
        part = {w: t[i + 1 : ends[ends.index(i) + 1]] for w, i in marks.items()}
        meta = self.meta(name)
        base = cut(self.spark.table(name).withColumn("__row", F.monotonically_increasing_id()))
        view = f"__base_{uuid.uuid4().hex[:8]}"
        base.createOrReplaceTempView(view)
        sets = {s[0]: s[2:] for s in self.split(part.get("SET", []))}
        missing = set(sets) - set(base.columns)
        if missing:
            raise ValueError(f"no such columns: {sorted(missing)}")
        kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
        news = ["named_struct", "(", *[w for c, e in sets.items() for w in (f"'{c}'", ",", "CAST", "(", *(e if [x.upper() for x in e] != ["DEFAULT"] else [meta["defaults"].get(c, "NULL")]), "AS", kinds[c], ")", ",")][:-1], ")"] if sets else ["0"]
        source = [",", *part.get("FROM", part.get("USING", []))] if "FROM" in part or "USING" in part else []
        where = ["WHERE", *part["WHERE"]] if "WHERE" in part else []
        hits = self.query(["SELECT", alias, ".", "__row", "AS", "__row", ",", *news, "AS", "__new", "FROM", view, "AS", alias, *source, *where])
        hits = cut(hits.groupBy("__row").agg(F.min("__new").alias("__new"), F.lit(True).alias("__hit")))
        joined = base.join(hits, "__row", "left")
        kept = [c for c in base.columns if c != "__row"]
        if deletes:
            touched = base.join(hits, "__row", "left_semi").select(*kept)
            result = joined.where("__hit is null").select(*kept, "__row")
        else:
            values = [F.when(F.col("__hit"), F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in kept]
            result = joined.select(*values, "__row")
            touched = result.join(hits, "__row", "left_semi").select(*kept)
        result = cut(result)
        returned = cut(touched) if "RETURNING" in part else None
        self._constraints(meta | {"foreign": [f for f in meta["foreign"] if f["parent"] != name]}).enforce(result.select(*kept))
        self._children(name, base, result)
        tables.replace(self.spark, name, result.select(*kept), meta)
        self.spark.catalog.dropTempView(view)
        return self._returned(returned, part["RETURNING"]) if returned is not None else None

    def _children(self, name: str, old: DataFrame, new: DataFrame) -> None:
        """What foreign keys ask for when keys of their parent go or change."""
        for child, meta, f in self.children(name):
            was = old.select("__row", *[F.col(k).alias(f"__old{i}") for i, k in enumerate(f["key"])])
            now = new.select("__row", F.lit(True).alias("__stays"), *[F.col(k).alias(f"__new{i}") for i, k in enumerate(f["key"])])
            moved = was.join(now, "__row", "left")
            same = F.lit(True)
            for i in range(len(f["key"])):
                same = same & F.col(f"__old{i}").eqNullSafe(F.col(f"__new{i}"))
            moved = cut(moved.where(F.col("__stays").isNull() | ~same).drop("__row"))
            table = self.spark.table(child)
            on = [table[c] == moved[f"__old{i}"] for i, c in enumerate(f["columns"])]
            if moved.isEmpty() or table.join(moved, on, "left_semi").isEmpty():
                continue
            stays = F.coalesce(F.col("__stays"), F.lit(False))
            met = cut(table.join(moved, on, "left").withColumn("__met", F.col("__old0").isNotNull()))
            for action, which in ((f["delete"], F.col("__met") & ~stays), (f["update"], F.col("__met") & stays)):
                if action == "restrict" and not met.where(which).isEmpty():
                    raise ConstraintViolation("23503", f"update or delete on {name} violates foreign key {f['name']} of {child}")
            if f["delete"] == "cascade":
                met = met.where(~F.col("__met") | stays)
            values = []
            for field in table.schema.fields:
                c = F.col(field.name)
                if field.name in f["columns"]:
                    i = f["columns"].index(field.name)
                    default = F.expr(meta["defaults"].get(field.name, "NULL"))
                    for action, which in ((f["delete"], F.col("__met") & ~stays), (f["update"], F.col("__met") & stays)):
                        to = {"set null": F.lit(None), "set default": default, "cascade": F.col(f"__new{i}")}.get(action)
                        c = c if to is None else F.when(which, to).otherwise(c)
                values.append(c.cast(field.dataType).alias(field.name))
            tables.replace(self.spark, child, met.select(*values), meta)

    # Files

    def copy(self, t: Tokens, up: Tokens) -> None:
        """COPY t [(columns)] FROM 'path' and COPY t | (query) TO 'path', [WITH] [(] FORMAT csv, HEADER [true|false], DELIMITER 'x', NULL 'x' [)]."""
        depth, at = 0, 0
        for i, w in enumerate(up):
            depth += (w == "(") - (w == ")")
            if not depth and w in ("FROM", "TO"):
                at = i
                break
        path, options = t[at + 1][1:-1], t[at + 2 :]
        words = [w.upper() for w in options]
        value = lambda name, default: options[words.index(name) + 1][1:-1] if name in words else default
        header = "HEADER" in words and words[words.index("HEADER") + 1 : words.index("HEADER") + 2] not in (["FALSE"], ["OFF"])
        if up[at] == "TO":
            rows = self.query(t[2 : at - 1]) if t[1] == "(" else self.spark.table(t[1])
            files.copy_to(rows, path, value("DELIMITER", ","), header, null=value("NULL", ""))
            return
        table, meta = self.spark.table(t[1]), self.meta(t[1])
        columns = [c[0] for c in self.split(t[3 : at - 1])] if t[2] == "(" else table.columns
        new = files.copy_from(self.spark, path, table.select(*columns).schema, value("DELIMITER", ","), header, null=value("NULL", ""))
        new = cut(self._whole(new, list(columns), table, meta, t[1]))
        both = table.unionByName(new)
        self._constraints(meta).enforce(both)
        new.write.insertInto(t[1])

    # Sequences: a table of one row each

    def create_sequence(self, t: Tokens, up: Tokens) -> None:
        name = next(x for x, u in zip(t[2:], up[2:]) if u not in ("IF", "NOT", "EXISTS"))
        if "EXISTS" in up and self.spark.catalog.tableExists(f"sequence_{name}"):
            return
        number = lambda word, least: next((int("".join(t[i + (up[i + 1] == least) + 1 :][: 2 if t[i + (up[i + 1] == least) + 1] == "-" else 1])) for i in range(len(t) - 1) if up[i] == word), 1)
        self._set_sequence(name, None, number("START", "WITH"), number("INCREMENT", "BY"))

    def _set_sequence(self, name: str, last: int | None, following: int, step: int) -> None:
        rows = self.spark.createDataFrame([(last, following, step)], "last long, next long, step long")
        if self.spark.catalog.tableExists(f"sequence_{name}"):
            tables.replace(self.spark, f"sequence_{name}", rows)
        else:
            tables.create(self.spark, f"sequence_{name}", rows)

    def sequence_call(self, call: str, name: str, value: int | None = None, called: bool = True) -> int:
        last, following, step = self.spark.table(f"sequence_{name}").first()
        if call == "currval":
            if last is None:
                raise ValueError(f"currval of sequence {name} is not yet defined")
            return last
        if call == "setval":
            self._set_sequence(name, value, value + step if called else value, step)
            return value
        self._set_sequence(name, following, following + step, step)
        return following
