"""Row-level security: a small expression language parsed to filters, and privileges over role closures."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.filters import match
from larkspur.plans.pipeline import aggregate

DENY = {"$or": []}
#: Fixed privilege bits.
PRIVILEGES = {
    "SELECT": 1, "INSERT": 2, "UPDATE": 4, "DELETE": 8, "CREATE": 16, "DROP": 32, "ALTER": 64, "INDEX": 128, "TRUNCATE": 256,
    "REFERENCES": 512, "TRIGGER": 1024, "EXECUTE": 2048, "USAGE": 4096, "CREATE_TEMP": 8192, "CONNECT": 16384, "ALL": 0xFFFFFFFF,
}
#: Fixed names of the roles that every system has.
SYSTEM_ROLES = ["superuser", "db_admin", "user_admin", "read_write", "read_only", "public"]
MOST_FAILURES = 5
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<num>-?\d+(?:\.\d+)?)|(?P<op>!=|<>|<=|>=|[=<>(),])|(?P<name>\$?[A-Za-z_][\w.]*(?:\(\))?))""")
_OPS = {"=": "$eq", "!=": "$ne", "<>": "$ne", "<": "$lt", "<=": "$lte", ">": "$gt", ">=": "$gte"}


@dataclass
class Policy:
    name: str
    command: str = "ALL"
    roles: list[str] = field(default_factory=list)
    using: str = ""
    check: str = ""
    enabled: bool = True

    def applies(self, command: str, roles: set[str]) -> bool:
        return self.enabled and self.command in ("ALL", command) and (not self.roles or bool(roles & set(self.roles)))


def parse(text: str, user: str = "", database: str = "") -> dict:
    """Filter for an expression; empty text allows all, and text that does not parse denies all."""
    if not text.strip():
        return {}
    try:
        tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(text[at:])
            tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        reader = _Reader(tokens, {"current_user": user, "current_user_id": user, "current_database": database, "$user": user, "$database": database})
        out = reader.either()
        if reader.at != len(tokens):
            raise ValueError("trailing input")
        return out
    except (ValueError, IndexError):
        return DENY


class _Reader:
    def __init__(self, tokens: list, variables: dict):
        self.tokens, self.at, self.variables = tokens, 0, variables

    def word(self, *words: str) -> bool:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1].upper() in words:
            self.at += 1
            return True
        return False

    def either(self) -> dict:
        parts = [self.both()]
        while self.word("OR"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else {"$or": parts}

    def both(self) -> dict:
        parts = [self.single()]
        while self.word("AND"):
            parts.append(self.single())
        return parts[0] if len(parts) == 1 else {"$and": parts}

    def single(self) -> dict:
        if self.word("NOT"):
            return {"$not": self.single()}
        if self.word("("):
            inner = self.either()
            if not self.word(")"):
                raise ValueError("unclosed")
            return inner
        if self.word("TRUE"):
            return {}
        if self.word("FALSE"):
            return DENY
        kind, name = self.tokens[self.at]
        if kind != "name":
            raise ValueError(name)
        self.at += 1
        if self.word("IN"):
            if not self.word("("):
                raise ValueError("IN needs a list")
            values = [self.value()]
            while self.word(","):
                values.append(self.value())
            if not self.word(")"):
                raise ValueError("unclosed list")
            return {name: {"$in": values}}
        op = _OPS[self.tokens[self.at][1]] if self.tokens[self.at][1] in _OPS else None
        if op is None:
            raise ValueError("no comparison")
        self.at += 1
        return {name: {op: self.value()}}

    def value(self):
        kind, raw = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", raw[1:-1])
        if kind == "num":
            return float(raw) if "." in raw else int(raw)
        if kind != "name":
            raise ValueError(raw)
        known = {"TRUE": True, "FALSE": False, "NULL": None}
        if raw.upper() in known:
            return known[raw.upper()]
        return self.variables.get(raw.removesuffix("()"), raw)


def visible(policies: list[Policy], command: str, roles: set[str], user: str = "", database: str = "", check: bool = False) -> dict:
    """Filter of the rows that the policies allow: any of the applicable ones, none applicable denies all. check: for rows written."""
    parts = [parse((p.check or p.using) if check else p.using, user, database) for p in policies if p.applies(command, roles)]
    if not parts:
        return DENY
    return {} if {} in parts else parts[0] if len(parts) == 1 else {"$or": parts}


def secure(df: DataFrame, policies: list[Policy] | None, command: str = "SELECT", roles: set[str] = frozenset(), user: str = "", database: str = "", check: bool = False) -> DataFrame:
    """Rows of df that may be seen (or written). None: security is off for the collection. The filter goes below all other stages."""
    return df if policies is None else match(df, visible(policies, command, set(roles), user, database, check))


def closure(role: str, parents: dict[str, list[str]]) -> set[str]:
    """A role, all it inherits from, and public."""
    seen, todo = {"public"}, [role]
    while todo:
        r = todo.pop()
        if r not in seen:
            seen.add(r)
            todo += parents.get(r, [])
    return seen


def grant(bits: int, *names: str) -> int:
    for n in names:
        bits |= PRIVILEGES[n]
    return bits


def revoke(bits: int, *names: str) -> int:
    for n in names:
        bits &= ~PRIVILEGES[n]
    return bits


def allowed(permissions: list[dict], roles: set[str], target: dict, *names: str) -> bool:
    """Whether one permission row of the roles, its empty target fields standing for any, has all the privileges."""
    need = grant(0, *names)
    fits = lambda p: all(not p["target"].get(k) or p["target"][k] == v for k, v in target.items())
    return any(p["role"] in roles and fits(p) and p["privileges"] & need == need for p in permissions)


def locked_out(attempts: DataFrame, user: str, seq: str, ok: str, most: int = MOST_FAILURES) -> DataFrame:
    """user, locked_at: users with `most` failures without a success between, and the attempt that locked them."""
    runs = attempts.withColumn("_run", F.sum(F.col(ok).cast("int")).over(Window.partitionBy(user).orderBy(seq)))
    failed = runs.where(~F.col(ok)).withColumn("_n", F.row_number().over(Window.partitionBy(user, "_run").orderBy(seq)))
    return failed.where(F.col("_n") == most).groupBy(user).agg(F.min(seq).alias("locked_at"))


@dataclass
class Guard:
    """Privileges and policies of one user, at every way into a collection."""

    roles: set[str]
    permissions: list[dict]
    policies: dict[str, list[Policy]]
    user: str = ""
    database: str = ""

    def may(self, name: str, *privileges: str) -> bool:
        return "superuser" in self.roles or allowed(self.permissions, self.roles, {"type": "collection", "name": name}, *privileges)

    def rows(self, df: DataFrame, name: str, command: str = "SELECT", check: bool = False) -> DataFrame:
        """Rows of the collection that the user may see, change or (check) write."""
        if not self.may(name, command):
            raise PermissionError(f"{command} on {name}")
        return df if "superuser" in self.roles else secure(df, self.policies.get(name), command, self.roles, self.user, self.database, check)

    def aggregate(self, name: str, stages: list[dict], collections: dict[str, DataFrame], **settings) -> DataFrame:
        """A pipeline over the visible rows; collections that $lookup reads are held to their own policies too."""
        read = {s["$lookup"]["from"] for s in stages if isinstance(s.get("$lookup"), dict) and s["$lookup"].get("from") in collections}
        seen = {n: self.rows(collections[n], n) for n in read}
        return aggregate(self.rows(collections[name], name), stages, seen, **settings)

    def written(self, new: DataFrame, name: str) -> DataFrame:
        """new, if all its rows may be written."""
        kept = self.rows(new, name, "INSERT", check=True)
        if not new.exceptAll(kept).isEmpty():
            raise PermissionError(f"rows outside the policies of {name}")
        return new
