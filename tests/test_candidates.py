import re

from sparkloom.functions import text as fn
from sparkloom.plans import catalog


class Tables:
    def __init__(self, df):
        self.df = df

    def table(self, name):
        return self.df


def brute(text):
    if text is None:
        return None
    words = [w for w in re.findall("[a-z0-9]+", text.lower()) if len(w) > 1 and w not in fn.STOP_WORDS]
    return " ".join(dict.fromkeys(x for w in words for x in (w, *fn.ALIASES.get(w, ()))))


def test_every_row_with_its_aliases(spark):
    texts = ["plain words", None, "", *(f"Please {w} red {w} ring" for w in sorted(fn.ALIASES))]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string")
    got = {r.conv_id: r.words for r in catalog.q_fn_candidates(Tables(df)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
