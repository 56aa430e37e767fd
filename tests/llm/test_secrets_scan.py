import random
import re

import numpy as np
import pytest

from sparkloom.llm import secrets_scan as S
from sparkloom.llm.common import string_buffers

import pyarrow as pa

PIECES = ["AKIA" + "A1B2" * 4, "ghp_" + "a1" * 18, "xoxb-" + "1-a" * 6, "password = hunter22", 'token="' + "ab12" * 5 + '"', "sk_live_" + "Z9" * 10, "-----BEGIN RSA PRIVATE KEY-----", "eyJabcdefgh.abcdefgh12.ABCdefgh-_", "AIza" + "x" * 35, " ", "\n", ".", "-", "é", "plain words", "Password: ", "=", '"', "a" * 40]


def brute(texts, rules):
    out = []
    for d, t in enumerate(texts):
        for k, rule in enumerate(rules.values()):
            for m in re.finditer(rb"(?<![0-9A-Za-z_.\-])(?:" + rule.encode() + rb")", (t or "").encode()):
                if m.end() > m.start():
                    out.append((d, k, m.start(), m.end()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_against_a_regex_engine(seed):
    r = random.Random(seed)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 12))) for _ in range(150)] + [None, ""]
    raw, offsets = string_buffers(pa.array(texts, pa.string()), lower=False)
    assert S.Scanner().scan(raw, offsets) == brute(texts, S.RULES)


def test_one_pass_marks_every_end():
    scanner = S.Scanner({"a": "ab+", "b": "b{2}"})
    raw, offsets = string_buffers(pa.array(["abbb bb"]), lower=False)
    ends, marks = scanner.ends(raw, offsets)
    assert dict(zip(ends.tolist(), marks.tolist())) == {2: 1, 3: 1, 4: 1, 7: 2}


def test_automaton_is_minimal():
    d = S.DFA([S.parse("(aa|ba)c"), ], frozenset())
    assert d.states == 5  # start, one letter, two letters, end, dead
    assert np.count_nonzero(d.mark) == 1


def test_long_match_is_linear(make):
    text = "x token=" + "a" * 200_000 + " end"
    got = S.find_secrets(make((1, text))).collect()
    assert [(r.rule, r.start_byte, r.end_byte) for r in got] == [("token", 2, len(text) - 4)]


def test_odd_rows(odd, none):
    assert S.find_secrets(odd).count() == 0
    assert S.find_secrets(none).count() == 0


@pytest.mark.parametrize("bad", ["(a", "a)"])
def test_bad_rules_are_refused(bad):
    with pytest.raises((ValueError, IndexError)):
        S.parse(bad)


GLUE = PIECES + ["DB_PASSWORD=hunter22x", "AWS_SECRET=" + "ab12" * 5, "glpat-" + "a1" * 10, "npm_" + "Z9" * 18, "SG." + "ab" * 11 + "." + "c" * 43, "https://hooks.slack.com/services/T00000000/B00000000/" + "x1" * 12, "AccountKey=" + "ab/+" * 20 + "==", "a", "_", "DB_", "my_", "\\n", "id-", "token: ", "api_key=", "p@ssw0rd!", "eyJ", "AKIA", "AIza", "xoxb-"]


@pytest.mark.parametrize("seed", range(4))
def test_begins_anywhere_against_plain_expressions(make, seed):
    r = random.Random(seed)
    texts = ["".join(r.choice(GLUE) for _ in range(r.randint(0, 14))) for _ in range(300)]
    names = list(S.RULES)
    want = sorted((d, names.index(k), *m.span()) for d, t in enumerate(texts) for k, rule in S.RULES.items() for m in re.finditer(rule.encode(), t.encode()))
    got = [(x.doc_id, names.index(x.rule), x.start_byte, x.end_byte) for x in S.find_secrets(make(*enumerate(texts))).collect()]
    assert sorted(got) == want and want


@pytest.mark.parametrize("rule, text", [("password", "db_password = hunter22"), ("password", "spring.datasource.password=hunter22"), ("password", "password: p@ssw0rd!"), ("token", "client_secret=" + "ab12" * 5), ("token", "my_api_key=" + "ab12" * 5), ("token", "access_token: " + "ab12" * 5), ("aws_access_key", "id-AKIA" + "A1B2" * 4), ("github_token", "key_ghp_" + "a1" * 18), ("private_key", "\\n-----BEGIN PRIVATE KEY-----")])
def test_common_forms(make, rule, text):
    (r,) = S.find_secrets(make((1, text))).collect()
    assert r.rule == rule and r.end_byte == len(text)


def test_failed_attempts_are_linear(make):
    assert S.find_secrets(make((1, "eyJ" * 100_000))).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_long_texts_in_several_lanes(seed, monkeypatch):
    monkeypatch.setattr(S, "LANE_BYTES", 16)
    r = random.Random(seed)
    texts = ["".join(r.choice(GLUE) for _ in range(r.choice([0, 1, 3, 200]))) for _ in range(40)]
    raw, offsets = string_buffers(pa.array(texts), lower=False)
    names = list(S.RULES)
    want = sorted((d, names.index(k), *m.span()) for d, t in enumerate(texts) for k, rule in S.RULES.items() for m in re.finditer(rule.encode(), t.encode()))
    assert S.Scanner(S.RULES, frozenset()).scan(raw, offsets) == want and want
