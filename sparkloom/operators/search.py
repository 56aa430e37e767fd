"""Symbol and document search: exact, substring, ranked full text, prose and segments. Filters apply before limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparkloom.functions import text as fn
from sparkloom.operators.lookups import matching, segment_vocabulary

#: Columns of a symbol that are searched, those that a table has.
COLUMNS = ("name", "qualified_name", "docstring", "signature")
K1, B = 1.2, 0.75


def exact(nodes: DataFrame, name: str, limit: int = 20) -> DataFrame:
    return nodes.where(F.col("name") == name).withColumn("score", F.lit(1.0)).orderBy("file_path", "start_line", "id").limit(limit)


def match_class(text: Column, word: str) -> Column:
    """0 for the word itself, 1 for a prefix, 2 for any other place."""
    return F.when(text == word, 0).when(text.startswith(word), 1).otherwise(2)


def substring(nodes: DataFrame, words: list[str], limit: int = 20, score: float = 0.6, case_sensitive: bool = False, columns: tuple[str, ...] = ("name", "qualified_name")) -> DataFrame:
    """Per word the best `limit` nodes that contain it literally; a node that several words find comes once, by its best place."""
    out = None
    for k, word in enumerate(words):
        low = (lambda c: c) if case_sensitive else F.lower
        word = word if case_sensitive else word.lower()
        has = reduce(lambda a, b: a | b, (F.coalesce(low(F.col(c)).contains(word), F.lit(False)) for c in columns if c in nodes.columns))
        found = nodes.where(has).withColumn("match_class", match_class(low(F.col("name")), word)).orderBy("match_class", "name", "id").limit(limit)
        found = found.withColumn("_word", F.lit(k))
        out = found if out is None else out.unionByName(found)
    best = out.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy("match_class", "_word"))).where("_n = 1")
    return best.drop("_n", "_word").withColumn("score", F.lit(score))


# ---- BM25 ----


def hits(terms: Column, phrase: list[str]) -> Column:
    """Occurrences of a phrase in an array of terms, its last word as a prefix."""
    if len(phrase) == 1:
        return F.size(F.filter(terms, lambda t: t.startswith(phrase[0])))
    m = len(phrase)
    at = lambda i: reduce(lambda a, b: a & b, (*(terms[i + j] == phrase[j] for j in range(m - 1)), terms[i + (m - 1)].startswith(phrase[-1])))
    return F.when(F.size(terms) < m, 0).otherwise(F.size(F.filter(F.sequence(F.lit(0), F.greatest(F.size(terms) - m, F.lit(0))), at)))


def bm25(rows: DataFrame, columns: list[str], words: list[str], require_all: bool = True) -> DataFrame:
    """rows that have all (or any) of the words, each a prefix phrase, with `rank`: lower is better.

    One scan gives each row its counts and length; the corpus's three kinds of totals are one aggregated row.
    """
    phrases = [p for p in (_terms(w) for w in words) if p]
    if not phrases:
        return rows.where(F.lit(False)).withColumn("rank", F.lit(0.0))
    cols = [c for c in columns if c in rows.columns]
    cut = rows.select("*", *(fn.tokens(F.col(c)).alias(f"_t{i}") for i, c in enumerate(cols)))
    size = reduce(lambda a, b: a + b, (F.size(f"_t{i}") for i in range(len(cols))))
    tf = [reduce(lambda a, b: a + b, (hits(F.col(f"_t{i}"), p) for i in range(len(cols)))) for p in phrases]
    counted = cut.select(*rows.columns, size.alias("_len"), *(x.alias(f"_tf{j}") for j, x in enumerate(tf)))
    n = [F.count_if(F.col(f"_tf{j}") > 0).alias(f"_n{j}") for j in range(len(phrases))]
    corpus = counted.agg(F.count(F.lit(1)).alias("_all"), F.avg("_len").alias("_avg"), *n)
    all_of = reduce((lambda a, b: a & b) if require_all else (lambda a, b: a | b), (F.col(f"_tf{j}") > 0 for j in range(len(phrases))))
    both = counted.where(all_of).crossJoin(F.broadcast(corpus))  # one row
    idf = [F.greatest(F.log((F.col("_all") - F.col(f"_n{j}") + 0.5) / (F.col(f"_n{j}") + 0.5)), F.lit(1e-6)) for j in range(len(phrases))]
    norm = K1 * (1 - B + B * F.col("_len") / F.col("_avg"))
    rank = reduce(lambda a, b: a + b, (idf[j] * F.col(f"_tf{j}") * (K1 + 1) / (F.col(f"_tf{j}") + norm) for j in range(len(phrases))))
    return both.select(*rows.columns, (-rank).alias("rank"))


def _terms(word: str) -> list[str]:
    import re

    return re.findall(r"[^\W_]+", word.lower())


def _runs(rows: DataFrame, key: str, terms: Column) -> DataFrame:
    """(key, len, term, tf, head) of the distinct terms of every row, counted within the row: runs of equal terms of the sorted
    list. head is true for one of a row's; a row without terms has one row with a null term."""
    cut = rows.select(key, F.sort_array(terms).alias("_t")).select(key, "_t", F.size("_t").alias("len"))
    first = F.filter(F.sequence(F.lit(0), F.greatest(F.col("len") - 1, F.lit(0))), lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", i - 1)))
    cut = cut.select(key, "_t", "len", first.alias("_f"))
    runs = F.transform("_f", lambda i, j: F.struct(F.get("_t", i).alias("term"), (F.coalesce(F.get("_f", j + 1), F.col("len")) - i).cast("long").alias("tf"), (j == 0).alias("head")))
    return cut.select(key, "len", F.inline(runs))


def _unique(rows: DataFrame, key: str) -> bool:
    """Whether no two rows have one key, so that counts within rows are whole."""
    found = rows.select(key).groupBy(key).count().agg(F.max("count")).first()[0]
    return (found or 0) <= 1


def postings(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(term, key, tf): an inverted index, to be stored sorted by term where one corpus is asked often. Only rows that share
    their key are added up across tasks; otherwise nothing but the keys is shuffled."""
    found = _runs(rows, key, fn.tokens(F.col(column))).where("term IS NOT NULL").select("term", key, "tf")
    return found if _unique(rows, key) else found.groupBy("term", key).agg(F.sum("tf").alias("tf"))


def inverted(rows: DataFrame, key: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(term, key, tf, len, head): the inverted index of several columns at once, len the number of terms of a row in all, head
    true for one entry of each key; a row without terms has one entry with a null term. To be stored sorted by term."""
    cols = [c for c in columns if c in rows.columns]
    found = _runs(rows, key, F.flatten(F.array(*(fn.tokens(F.col(c)) for c in cols)))).select("term", key, "tf", "len", "head")
    if _unique(rows, key):
        return found
    found = found.groupBy("term", key).agg(F.sum("tf").alias("tf"), F.first("len").alias("len"))
    return found.withColumn("head", F.row_number().over(W.partitionBy(key).orderBy("term")) == 1)


def indexed_bm25(index: DataFrame, totals: DataFrame, key: str, words: list[str], require_all: bool = True) -> DataFrame:
    """(key, rank) as of bm25, from a stored inverted index: only the entries of terms that begin with a word are read.

    words are single terms. totals is one row: the number of indexed rows, `n`, and their mean length, `mean`.
    """
    terms = [_terms(w)[0] for w in words]
    hit = [F.col("term").startswith(t) for t in terms]
    found = index.where(reduce(lambda a, b: a | b, hit)).groupBy(key).agg(F.first("len").alias("_len"), *(F.sum(F.when(h, F.col("tf")).otherwise(0)).alias(f"_tf{j}") for j, h in enumerate(hit)))
    n = found.agg(*(F.count_if(F.col(f"_tf{j}") > 0).alias(f"_n{j}") for j in range(len(terms))))
    ok = reduce((lambda a, b: a & b) if require_all else (lambda a, b: a | b), (F.col(f"_tf{j}") > 0 for j in range(len(terms))))
    both = found.where(ok).crossJoin(F.broadcast(n)).crossJoin(F.broadcast(totals))  # one row each
    idf = [F.greatest(F.log((F.col("n") - F.col(f"_n{j}") + 0.5) / (F.col(f"_n{j}") + 0.5)), F.lit(1e-6)) for j in range(len(terms))]
    norm = K1 * (1 - B + B * F.col("_len") / F.col("mean"))
    rank = reduce(lambda a, b: a + b, (idf[j] * F.col(f"_tf{j}") * (K1 + 1) / (F.col(f"_tf{j}") + norm) for j in range(len(terms))))
    return both.select(key, (-rank).alias("rank"))


def index_totals(index: DataFrame, key: str) -> DataFrame:
    """The one row that indexed_bm25 needs beside the index."""
    per = index.where("head") if "head" in index.columns else index.groupBy(key).agg(F.first("len").alias("len"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))


def _ranked(nodes: DataFrame, words: list[str], require_all: bool, index: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """nodes with rank, by a stored index where there is one and every word is one term."""
    if index is None or not words or any(len(_terms(w)) != 1 for w in words):
        return bm25(nodes, list(COLUMNS), words, require_all)
    return nodes.join(indexed_bm25(*index, "id", words, require_all), "id").select(*nodes.columns, "rank")


def full_text(nodes: DataFrame, words: list[str], limit: int = 20, offset: int = 0, where: Column | None = None, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Nodes with all words, best first, `score` = 1 - rank / 100. No result if a word has two characters or fewer."""
    if any(len(w) <= 2 for w in words):
        return nodes.where(F.lit(False)).withColumn("rank", F.lit(0.0)).withColumn("score", F.lit(0.0))
    found = _ranked(nodes, words, True, index)
    found = found if where is None else found.where(where)
    return found.orderBy("rank", "id").offset(offset).limit(limit).withColumn("score", 1 - F.col("rank") / 100)


def any_word(nodes: DataFrame, words: list[str], limit: int = 20, where: Column | None = None, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The supplement for too few nodes with all words: any of them, at four fifths of the score."""
    found = _ranked(nodes, words, False, index)
    found = found if where is None else found.where(where)
    return found.orderBy("rank", "id").limit(limit).withColumn("score", F.when(F.col("rank") == 0, 0.4).otherwise((1 - F.col("rank") / 100) * 0.8))


def boosted(found: DataFrame, query: str) -> DataFrame:
    """score raised by how the name fits the query, at most to 1; a score of more than 1 that isn't raised stays."""
    name, words = F.lower("name"), query.lower().split()
    has = [name.contains(w) for w in words] or [F.lit(False)]
    boost = F.when(name == query.lower(), 0.5).when(name.startswith(query.lower()), 0.3).when(reduce(lambda a, b: a & b, has), 0.2).when(reduce(lambda a, b: a | b, has), 0.1).otherwise(0.0)
    return found.withColumn("score", F.when(boost > 0, F.least(F.col("score") + boost, F.lit(1.0))).otherwise(F.col("score")))


def search(nodes: DataFrame, query: str, limit: int = 20, mode: str = "text", index: tuple[DataFrame, DataFrame] | None = None, **filters) -> DataFrame:
    """Search as a user does: mode text, exact or substring. Text tries all words, then any, then parts of names. index: a
    stored (inverted(), index_totals()) of the nodes."""
    ok = matching(**filters)
    words = query.split()
    if mode == "exact":
        return exact(nodes.where(ok), query, limit)
    if mode == "substring" or not words:
        return substring(nodes.where(ok), words or [""], limit)
    cols = nodes.columns
    if all(len(w) > 2 for w in words):
        first = full_text(nodes, words, limit, where=ok, index=index).select(*cols, "rank", "score")
        if first.count() < max(limit // 2, 2):  # limit rows at most
            more = any_word(nodes, words, limit, ok, index).select(*cols, "rank", "score").join(first.select("id"), "id", "left_anti").select(*cols, "rank", "score")
            first = first.unionByName(more)
        got = boosted(first, query).orderBy("rank", "id").limit(limit)
        if not got.isEmpty():
            return got
    fallback = substring(nodes.where(ok), words, limit, 0.5).withColumn("rank", F.lit(0.0))
    return fallback.select(*cols, "rank", "score")


def fuzzy(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The query language's search: fields narrow, the rest is ranked with any word; score = |rank|."""
    q = fn.parse_query(query)
    ok = matching(kinds=q.kinds, languages=q.languages, paths=q.paths)
    if not q.text:
        return nodes.where(ok).orderBy("name", "id").limit(limit).withColumn("score", F.lit(0.0))
    got = bm25(nodes, list(COLUMNS), q.text.split(), require_all=False).where(ok).orderBy("rank", "id").limit(limit).withColumn("score", F.abs("rank")).drop("rank")
    return containing(nodes.where(ok), q.text, limit) if got.isEmpty() else got


def containing(nodes: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """The step after ranked search found nothing: names, qualified names or docstrings with the whole text anywhere in them, whatever its case; score 0.5."""
    has = reduce(lambda a, b: a | b, (F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False)) for c in ("name", "qualified_name", "docstring") if c in nodes.columns))
    return nodes.where(has).orderBy("name", "id").limit(limit).withColumn("score", F.lit(0.5))


def prose(nodes: DataFrame, sentence: str) -> DataFrame:
    """(name, file_path, matched_words, n_words): names that have words of a sentence, or their aliases, as segments."""
    words = nodes.sparkSession.range(1).select(F.explode(fn.candidates(F.lit(sentence))).alias("segment"))
    hit = segment_vocabulary(nodes).join(F.broadcast(words), "segment")  # the words of one sentence
    got = nodes.where("kind <> 'file'").select("name", "file_path").distinct().join(hit, "name").groupBy("name", "file_path").agg(F.sort_array(F.collect_set("segment")).alias("matched_words"))
    return got.withColumn("n_words", F.size("matched_words")).orderBy(F.desc("n_words"), "name", "file_path")


def segment_matches(nodes: DataFrame, words: list[str]) -> DataFrame:
    """(name, word): names with one of the words as a segment; the first word wins. Words of one letter are left out."""
    asked = [(w.lower(), k) for k, w in enumerate(words) if len(w) > 1]
    if not asked:
        return nodes.where(F.lit(False)).select("name", F.col("name").alias("word"))
    given = nodes.sparkSession.createDataFrame(asked, "segment string, place int")
    return segment_vocabulary(nodes).join(F.broadcast(given), "segment").groupBy("name").agg(F.min_by("segment", "place").alias("word"))  # the words asked for


def best_node(nodes: DataFrame, name: str) -> DataFrame:
    """The one node that a view shows for a name: an exact one before the best found."""
    found = search(nodes, name, 20)
    return found.orderBy((F.col("name") != name).cast("int"), "rank", "id").limit(1)
