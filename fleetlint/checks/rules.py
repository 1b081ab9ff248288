"""Rules as rows: patterns, keywords and settings that a catalog brings along.

Three optional tables extend the fixed rules without code:

* ``rule_patterns(class, pattern)``: a Java regular expression that puts a statement into a class of
  ``sql_patterns.STATEMENT_PATTERNS`` (or into one of the user's own, seen in ``pattern_statements``);
* ``rule_keywords(list, keyword)``: a keyword of the list ``function_writes`` (upper case);
* ``rule_settings(check_name, name, op, target, severity)``: a rule of a setting check; for ``spock_gucs`` the
  target is the recommended value.  A row for a setting that has a rule of that check takes its place.

Rule tables are read to the driver once per catalog, at most ``RULE_ROWS`` rows
each (more is an error), and become literals of the plans: all patterns of all classes are
compiled into one alternation that is tried first, so a text that no rule concerns is read once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RULE_ROWS = 10_000


def rule_rows(cat, table: str, *columns: str) -> list[tuple]:
    """The distinct rows of an optional rule table, in order; none where the catalog has no such table."""
    if not cat.has(table):
        return []
    with cat._lock:
        if ("rules", table) not in cat._memo:
            rows = cat[table].select(*columns).dropna().distinct().limit(RULE_ROWS + 1).collect()
            if len(rows) > RULE_ROWS:
                raise ValueError(f"{table} has more than {RULE_ROWS} rows")
            cat._memo[("rules", table)] = sorted(map(tuple, rows))
        return cat._memo[("rules", table)]


def statement_rules(cat, fixed: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """(class, patterns) of every class: the fixed pattern and the patterns of the rule rows."""
    out = {c: [rx] for c, rx in fixed}
    for c, rx in rule_rows(cat, "rule_patterns", "class", "pattern"):
        out.setdefault(c, []).append(rx)
    return list(out.items())


def either(patterns: list[str]) -> str:
    """One alternation; each pattern keeps its own flags."""
    return "|".join(f"(?:{p})" for p in patterns)


def matched_classes(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The classes that a text is in; one pass over a text that is in none."""
    classes = F.array_compact(F.array(*[F.when(text.rlike(either(ps)), F.lit(c)) for c, ps in rules]))
    return F.when(text.rlike(either([p for _, ps in rules for p in ps])), classes).otherwise(F.expr("cast(array() as array<string>)"))


def keywords(cat, name: str, fixed: list[str]) -> list[str]:
    """The fixed keywords and those of the rule rows, once each."""
    return list(dict.fromkeys([*fixed, *[k.upper() for n, k in rule_rows(cat, "rule_keywords", "list", "keyword") if n == name]]))


def setting_rules(cat, fixed: list[tuple], checks: set[str] | None = None) -> list[tuple]:
    """(check, setting, op, target, severity): the fixed rules, replaced and extended by the rule rows of ``checks`` (or of any)."""
    out = {(r[0], r[1]): tuple(r) for r in fixed}
    for r in rule_rows(cat, "rule_settings", "check_name", "name", "op", "target", "severity"):
        if checks is None or r[0] in checks:
            out[(r[0], r[1])] = r
    return list(out.values())
