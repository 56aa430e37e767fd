"""URL filter by a weighted vocabulary.

One Aho-Corasick pass over the lower-cased URL finds every term; an occurrence counts if no letter or digit touches it.
A URL is rejected for one strict term, or for soft terms whose weights (each distinct term once) reach a limit.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkloom.llm.common import tidied
from sparkloom.llm.url_terms import SOFT, SOFT_LIMIT, STRICT

SCHEMA_REST = "url string, n_strict int, n_soft int, soft_weight int, rejected boolean"


def automaton(strict=STRICT, soft=SOFT) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t in {*soft, *strict}:
        if t:
            a.add_word(t.lower(), (t.lower(), t in strict))
    a.make_automaton()
    return a


def _plain(c: str) -> bool:
    return not ("a" <= c <= "z" or "0" <= c <= "9")


def judge(url: str | None, a: ahocorasick.Automaton, soft: dict[str, int], limit: int) -> tuple[int, int, int, bool]:
    """(distinct strict terms, distinct soft terms, their weight, rejected) of one URL."""
    s = (url or "").lower()
    hard, mild = set(), set()
    for end, (term, strict) in a.iter(s):
        start = end - len(term) + 1
        if (start == 0 or _plain(s[start - 1])) and (end + 1 == len(s) or _plain(s[end + 1])):
            (hard if strict else mild).add(term)
    weight = sum(soft[t] for t in mild)
    return len(hard), len(mild), weight, bool(hard) or weight >= limit


def filter_urls(pages: DataFrame, strict=STRICT, soft: dict[str, int] = SOFT, limit: int = SOFT_LIMIT) -> DataFrame:
    """One row for each row of pages, in no order: page_id, url, the counts and the verdict.

    A null or empty URL has no terms and isn't rejected; repeated rows get the same verdict; a term that is strict and soft
    is strict; terms that overlap each count, and so does a term within another, if boundaries are on its sides. A very long
    URL is searched whole, in one pass. page_id may be of any type and is kept. An empty table gives no rows. Only page_id and
    url are read. The vocabulary is a parameter shipped with the task.
    """
    strict, soft = tuple(t.lower() for t in strict), {k.lower(): v for k, v in soft.items() if k.lower() not in {t.lower() for t in strict}}

    def run(batches):
        a = automaton(strict, soft) if strict or soft else None
        for batch in batches:
            urls = batch.column(1).to_pylist()
            found = [judge(u, a, soft, limit) if a else (0, 0, 0, False) for u in urls]
            s, m, w, r = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.int32()), pa.array(m, pa.int32()), pa.array(w, pa.int32()), pa.array(r, pa.bool_())], ["page_id", "url", "n_strict", "n_soft", "soft_weight", "rejected"])

    schema = T.StructType([pages.select("page_id").schema[0], *T._parse_datatype_string(SCHEMA_REST).fields])
    return pages.select("page_id", "url").mapInArrow(tidied(run), schema)


def oracle(strict=STRICT, soft: dict[str, int] = SOFT, limit: int = SOFT_LIMIT) -> str:
    """Every term as a regular expression of its own, over a table of the terms."""
    rows = [(t, 1, 0) for t in strict] + [(t, 0, w) for t, w in soft.items() if t not in strict]
    terms = ", ".join(f"('(^|[^a-z0-9]){t}($|[^a-z0-9])', {s}, {w})" for t, s, w in rows)
    return f"""WITH t(e, s, w) AS (VALUES {terms}), u AS (SELECT DISTINCT url FROM pages),
f AS (SELECT url, sum(s) AS n_strict, count(*) - sum(s) AS n_soft, sum(w) AS soft_weight FROM u JOIN t ON regexp_matches(lower(url), e) GROUP BY url)
SELECT page_id, p.url, CAST(coalesce(n_strict, 0) AS INT) AS n_strict, CAST(coalesce(n_soft, 0) AS INT) AS n_soft, CAST(coalesce(soft_weight, 0) AS INT) AS soft_weight,
  coalesce(n_strict > 0 OR soft_weight >= {limit}, false) AS rejected FROM pages p LEFT JOIN f USING (url)"""
