r"""Secret scan by one combined deterministic automaton.

The rules' regular expressions are parsed into trees. A rule's head is what its matches begin with, cut to HEAD bytes:
short enough that the heads of all rules, beginning at any byte, make one small automaton, while whole rules would
multiply the counters of each other's tails in the subset construction. Subset construction and minimisation (partition
refinement, with the set of rules whose heads end as a state's mark) give one transition array over byte classes, which
is stepped once through all bytes of many documents at a time, side by side. Where a head ends, the reversed head gives
its starts, and the rule's own automaton goes on from there. Matches are leftmost-longest, without overlap per rule. What
a failed attempt has passed is remembered, so attempts that run into each other stay linear.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkloom.llm.common import doc_chunks, string_buffers, tidied

#: Literals, [classes], (a|b), ?, *, +, {m}, {m,n}, escapes and the classes d, w and s; bytes of ASCII. All rules have a bounded or greedy tail.
RULES = {
    "aws_access_key": r"(AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[0-9A-Za-z]{36}",
    "slack_token": r"xox[abprs]-[0-9A-Za-z-]{10,48}",
    "google_api_key": r"AIza[0-9A-Za-z_-]{35}",
    "private_key": r"-----BEGIN ((RSA|EC|DSA|OPENSSH) )?PRIVATE KEY-----",
    "json_web_token": r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    "stripe_key": r"(sk|rk)_(live|test)_[0-9A-Za-z]{16,32}",
    "password": r"[Pp](assword|ASSWORD|wd|asswd) ?[=:] ?[\"']?[!#-&(-~]{6,}",
    "token": r"([Tt](oken|OKEN)|[Ss](ecret|ECRET)|[Aa][Pp][Ii]_?[Kk](ey|EY)) ?[=:] ?[\"']?[0-9A-Za-z_-]{16,}[\"']?",
    "gitlab_token": r"glpat-[0-9A-Za-z_-]{20}",
    "npm_token": r"npm_[0-9A-Za-z]{36}",
    "sendgrid_key": r"SG\.[0-9A-Za-z_-]{22}\.[0-9A-Za-z_-]{43}",
    "slack_webhook": r"hooks\.slack\.com/services/T[0-9A-Z]{8,12}/B[0-9A-Z]{8,12}/[0-9A-Za-z]{20,}",
    "storage_key": r"AccountKey=[0-9A-Za-z+/]{40,}={0,2}",
}

SHARD_BYTES, LANES = 8 << 20, 4096
#: Bytes of a lane at least; a longer document is cut for the pass into lanes that overlap by the longest head.
LANE_BYTES = 2048
#: Bytes of a head at least, as far as the rule's shortest match goes.
HEAD = 6
_W = frozenset(range(48, 58)) | frozenset(range(65, 91)) | frozenset(range(97, 123)) | {95}
_ESC = {"d": frozenset(range(48, 58)), "w": _W, "s": frozenset(b" \t\n\r\f\v"), "n": frozenset(b"\n"), "t": frozenset(b"\t"), "r": frozenset(b"\r")}
ALL = frozenset(range(256))
INNER = _W | frozenset(b".-")


def parse(rule: str):
    """A tree of ("set", bytes), ("cat", parts), ("alt", parts) and ("rep", part, least, most or None)."""
    at = 0

    def escape():
        nonlocal at
        at += 1
        c = rule[at]
        at += 1
        return _ESC[c] if c in _ESC else frozenset([ord(c)])

    def klass():
        nonlocal at
        at += 1
        negated = rule[at] == "^"
        at += negated
        got: set[int] = set()
        first = True
        while rule[at] != "]" or first:
            first = False
            if rule[at] == "\\":
                one = escape()
            else:
                one, at = frozenset([ord(rule[at])]), at + 1
            if len(one) == 1 and rule[at] == "-" and rule[at + 1] != "]":
                at += 1
                if rule[at] == "\\":
                    end = max(escape())
                else:
                    end, at = ord(rule[at]), at + 1
                one = frozenset(range(min(one), end + 1))
            got |= one
        at += 1
        return ("set", ALL - got if negated else frozenset(got))

    def item():
        nonlocal at
        c = rule[at]
        if c == "(":
            at += 1
            x = alt()
            if at >= len(rule):
                raise ValueError(f"unclosed group in {rule}")
            at += 1
        elif c == "[":
            x = klass()
        elif c == "\\":
            x = ("set", escape())
        else:
            x, at = ("set", ALL - {10} if c == "." else frozenset([ord(c)])), at + 1
        while at < len(rule) and rule[at] in "?*+{":
            c = rule[at]
            if c == "{":
                end = rule.index("}", at)
                lo, comma, hi = rule[at + 1 : end].partition(",")
                x, at = ("rep", x, int(lo), (int(hi) if hi else None) if comma else int(lo)), end + 1
            else:
                x, at = ("rep", x, int(c == "+"), 1 if c == "?" else None), at + 1
        return x

    def cat():
        parts = []
        while at < len(rule) and rule[at] not in "|)":
            parts.append(item())
        return ("cat", parts)

    def alt():
        nonlocal at
        parts = [cat()]
        while at < len(rule) and rule[at] == "|":
            at += 1
            parts.append(cat())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    tree = alt()
    if at != len(rule):
        raise ValueError(f"unexpected {rule[at]} in {rule}")
    return tree


def reverse(tree):
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", reverse(tree[1]), *tree[2:])
    parts = [reverse(p) for p in tree[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


def least(tree) -> int:
    """Bytes of the shortest match."""
    kind = tree[0]
    if kind == "set":
        return 1
    if kind == "rep":
        return tree[2] * least(tree[1])
    return (sum if kind == "cat" else min)(map(least, tree[1]))


def longest(tree) -> int | None:
    """Bytes of the longest match, None if there is no bound."""
    kind = tree[0]
    if kind == "set":
        return 1
    if kind == "rep":
        one = longest(tree[1])
        return None if tree[3] is None or one is None else tree[3] * one
    parts = [longest(p) for p in tree[1]]
    return None if None in parts else (sum if kind == "cat" else max)(parts)


def head(tree, need: int = HEAD):
    """A tree of which every match of the given one begins with a match, of `need` bytes at least where the shortest match has them."""
    kind = tree[0]
    if kind == "set" or least(tree) < need:
        return tree
    if kind == "alt":
        return ("alt", [head(p, need) for p in tree[1]])
    if kind == "rep":
        one = least(tree[1])
        n = (need - 1) // one
        return ("cat", [("rep", tree[1], n, n), head(tree[1], need - n * one)])
    parts = []
    for p in tree[1]:
        parts.append(head(p, need))
        need -= least(p)
        if need <= 0:
            break
    return ("cat", parts)


class NFA:
    def __init__(self):
        self.eps: list[list[int]] = []
        self.on: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.on.append(None)
        return len(self.eps) - 1

    def add(self, tree, a: int) -> int:
        """Adds the tree from state a; returns its end."""
        kind = tree[0]
        if kind == "set":
            b = self.state()
            c = self.state()
            self.eps[a].append(c)
            self.on[c] = (tree[1], b)
            return b
        if kind == "cat":
            for p in tree[1]:
                a = self.add(p, a)
            return a
        if kind == "alt":
            b = self.state()
            for p in tree[1]:
                s = self.state()
                self.eps[a].append(s)
                self.eps[self.add(p, s)].append(b)
            return b
        _, part, least, most = tree
        for _ in range(least):
            a = self.add(part, a)
        if most is None:
            s, b = self.state(), self.state()
            self.eps[a].append(s)
            self.eps[s].append(b)
            self.eps[self.add(part, s)].append(s)
            return b
        b = self.state()
        self.eps[a].append(b)
        for _ in range(most - least):
            a = self.add(part, a)
            self.eps[a].append(b)
        return b

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.eps[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


class DFA:
    """Minimal automaton: step[state * classes + class_of[byte]], mark[state] a bit set of the rules that end there.

    A match may begin at the first byte and after any byte of restart.
    """

    def __init__(self, trees: list, restart: frozenset = frozenset()):
        nfa = NFA()
        start = nfa.state()
        ends: dict[int, int] = {}
        for k, tree in enumerate(trees):
            s = nfa.state()
            nfa.eps[start].append(s)
            ends.setdefault(nfa.add(tree, s), k)
        # byte classes: bytes that every set treats alike
        sets = sorted({o[0] for o in nfa.on if o} | {INNER, restart}, key=sorted)
        sig: dict[tuple, int] = {}
        self.class_of = np.array([sig.setdefault(tuple(b in s for s in sets), len(sig)) for b in range(256)], np.int32)
        some = {c: next(b for b in range(256) if self.class_of[b] == c) for c in range(len(sig))}
        first = nfa.closure([start])
        number, todo, step, mark = {first: 0}, [first], [], []
        while todo:
            now = todo.pop(0)
            mark.append(sum(1 << ends[s] for s in now if s in ends))
            row = []
            for c in range(len(sig)):
                to = {nfa.on[s][1] for s in now if nfa.on[s] and some[c] in nfa.on[s][0]}
                nxt = nfa.closure(to) | first if some[c] in restart else nfa.closure(to)
                if nxt not in number:
                    number[nxt] = len(number)
                    todo.append(nxt)
                row.append(number[nxt])
            step.append(row)
        step, mark = np.array(step), np.array(mark)
        part = np.unique(mark, return_inverse=True)[1]
        while True:  # Moore's refinement
            finer = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)[1].reshape(-1)
            if finer.max() == part.max():
                break
            part = finer
        # the start keeps number 0
        order = np.unique(part, return_index=True)[1]
        by = {int(part[0]): 0}
        for p in part[np.sort(order)].tolist():
            by.setdefault(p, len(by))
        rep = np.zeros(len(by), np.int64)
        for s in range(len(part) - 1, -1, -1):
            rep[by[int(part[s])]] = s
        self.classes = len(sig)
        self.step = np.array([by[int(part[t])] * self.classes for s in rep for t in step[s]], np.int32)
        self.mark = mark[rep].astype(np.int64)
        self.states = len(rep)


class Scanner:
    def __init__(self, rules: dict[str, str] = RULES, inner: frozenset = INNER):
        """A match begins at the text's start or after a byte outside inner; with an empty inner anywhere."""
        self.names, self.inner = list(rules), inner
        trees = [parse(r) for r in rules.values()]
        heads = [head(t) for t in trees]
        reach = [longest(t) for t in heads]
        #: How far back a head goes, where documents may be cut: matches begin anywhere and no head is without a bound.
        self.overlap = None if inner or None in reach else max(reach)
        self.all = DFA(heads, ALL - inner)
        self.one = [self._lists(DFA([t])) for t in trees]
        self.back = [self._lists(DFA([reverse(t)])) for t in heads]

    @staticmethod
    def _lists(d: DFA) -> tuple[list, list, list, list]:
        """(step, whether it's an end, whether nothing follows, class_of), the middle two by state times classes."""
        rows = d.step.reshape(d.states, d.classes)
        dead = (rows == (np.arange(d.states) * d.classes)[:, None]).all(1) & (d.mark == 0)
        return d.step.tolist(), np.repeat(d.mark != 0, d.classes).tolist(), np.repeat(dead, d.classes).tolist(), d.class_of.tolist()

    def _lanes(self, offsets: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, length, first byte whose ends count) of lanes, longest first: runs of documents, or parts of a long one."""
        size = np.diff(offsets)
        want = max(LANE_BYTES, -(-int(offsets[-1]) // lanes))
        if self.overlap is None:
            want = max(want, int(size.max()))
        rows, doc = [], 0
        while doc < len(size):
            lo = int(offsets[doc])
            if size[doc] > 2 * want:
                hi = int(offsets[doc + 1])
                rows += [(max(lo, b - self.overlap), min(hi, b + want), b) for b in range(lo, hi, want)]
                doc += 1
                continue
            end = max(doc + 1, int(np.searchsorted(offsets, lo + want, "right")) - 1)
            long = np.flatnonzero(size[doc:end] > 2 * want)
            doc = doc + int(long[0]) if len(long) else min(end, len(size))
            rows.append((lo, int(offsets[doc]), lo))
        begin, end, own = np.array(rows, np.int64).T
        order = np.argsort(begin - end, kind="stable")
        return begin[order], (end - begin)[order], own[order]

    def ends(self, raw: np.ndarray, offsets: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
        """(positions after the last byte, rule sets) of every head that ends somewhere, by one pass over all bytes."""
        d, n = self.all, len(raw)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin, length, own = self._lanes(offsets, lanes)
        fresh = np.zeros(n + 1, bool)
        fresh[offsets[:-1]] = True
        cls = d.class_of[raw]
        state = np.zeros(len(begin), np.int32)
        marked = d.mark != 0
        at_end, of_end = [], []
        active = len(begin) - np.searchsorted(length[::-1], np.arange(int(length[0])), "right")
        for t in range(int(length[0])):
            m = int(active[t])
            at = begin[:m] + t
            s = state[:m]
            f = fresh[at]
            if f.any():
                s[f] = 0
            s = d.step[s + cls[at]]
            state[:m] = s
            hit = marked[s // d.classes] & (at >= own[:m])
            if hit.any():
                k = np.flatnonzero(hit)
                at_end.append(at[k] + 1)
                of_end.append(d.mark[s[k] // d.classes])
        if not at_end:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(at_end), np.concatenate(of_end)

    def scan(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, rule, start, end) in bytes of the document, sorted."""
        ends, marks = self.ends(raw, offsets)
        if not len(ends):
            return []
        doc = np.searchsorted(offsets, ends - 1, "right") - 1
        found: dict[tuple[int, int], set[int]] = {}
        for e, m, d in zip(ends.tolist(), marks.tolist(), doc.tolist()):
            for k in range(len(self.names)):
                if m >> k & 1:
                    step, end, dead, cls = self.back[k]
                    s, lo = 0, int(offsets[d])
                    for i in range(e - 1, lo - 1, -1):
                        s = step[s + cls[raw[i]]]
                        if end[s] and (i == lo or raw[i - 1] not in self.inner):
                            found.setdefault((d, k), set()).add(i)
                        elif dead[s]:
                            break
        out = []
        for (d, k), starts in sorted(found.items()):
            step, end, dead, cls = self.one[k]
            lo, hi, upto = int(offsets[d]), int(offsets[d + 1]), -1
            vain: set[tuple[int, int]] = set()  # (position, state) from which no end follows
            for a in sorted(starts):
                if a < upto:
                    continue
                s, last, passed = 0, None, []
                for i in range(a, hi):
                    s = step[s + cls[raw[i]]]
                    if end[s]:
                        last, passed = i + 1, []
                    elif dead[s] or (i, s) in vain:
                        break
                    else:
                        passed.append((i, s))
                vain.update(passed)
                if last is not None:
                    out.append((d, k, a - lo, last - lo))
                    upto = last
        return out


def find_secrets(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """doc_id, rule, start_byte, end_byte of every match: leftmost-longest and without overlap, for each rule by itself.

    A match may begin at any byte. Offsets are in the UTF-8 bytes of text. Null and empty texts have no match; repeated rows
    give repeated matches; no match goes over the border of two documents; a very long text is passed over in several lanes,
    which changes no match. Of matches of one rule that begin at one byte the longest counts. An empty table gives no rows.
    Other columns are ignored.
    """

    built = docs.sparkSession.sparkContext.broadcast(Scanner(rules, frozenset()))  # as large as the rules make it

    def run(batches):
        scanner = built.value
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1), lower=False)
            for a, b in doc_chunks(offsets, SHARD_BYTES):
                found = scanner.scan(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if found:
                    d, k, s, e = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(d) + a)), pa.array([scanner.names[x] for x in k]), pa.array(s, pa.int64()), pa.array(e, pa.int64())], ["doc_id", "rule", "start_byte", "end_byte"])

    schema = T.StructType([docs.select("doc_id").schema[0], T.StructField("rule", T.StringType()), T.StructField("start_byte", T.LongType()), T.StructField("end_byte", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(tidied(run), schema)


__all__ = ["DFA", "RULES", "Scanner", "find_secrets", "head", "parse", "reverse"]
