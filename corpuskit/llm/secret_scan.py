"""Secret scans: fixed patterns, and formats learnt from the credentials that they find.

Credentials found by the patterns are labelled examples. From those of each kind a prefix tree is
built, whose states are merged while their futures are statistically compatible, into a
probabilistic automaton. One more automaton is learnt from other long tokens. Every candidate
token is then scored by how much more likely a credential's format is than that of other tokens.
"""

from __future__ import annotations

import math
import re
from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.sampling import picked

# The patterns of the contract, with the least length of what they find.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

LEARNT = "format"
# Characters of candidates; long runs of the two other fixed kinds lie within long runs of these.
RUN = "[A-Za-z0-9+/_.=-]"
LONG_RUN = re.compile(RUN + "{16,}")

# The training sample has these bounds, whatever the size of the corpus.
SAMPLE_DOCS = 50_000
CREDENTIALS = 500
OTHER_TOKENS = 1_000
LONGEST_EXAMPLE = 256
SHORTEST_EXAMPLE = 6

ALPHA = 0.05
SMOOTHING = 1e-3
# Of the labelled credentials so many percent may score below the line that candidates must reach.
MISSED_PERCENT = 5
MEMO_TOKENS = 200_000

SPANS = "array<struct<kind: string, start: bigint, end: bigint, score: double>>"

# Kinds of characters, and how many characters each has.
CLASSES = {"digits": "0123456789", "a to f": "abcdef", "g to z": "ghijklmnopqrstuvwxyz", "A to F": "ABCDEF",
           "G to Z": "GHIJKLMNOPQRSTUVWXYZ", **{c: c for c in "+/_.=-"}}
CLASS_OF = {c: i for i, chars in enumerate(CLASSES.values()) for c in chars}
EMITTED = [-math.log(len(chars)) for chars in CLASSES.values()]


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, secret) of the fixed patterns; leftmost and not overlapping within a kind."""
    out = []
    lowered = text.lower()
    if any(word in lowered for word in KEYWORDS):
        out += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for run in LONG_RUN.finditer(text):
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            out += [(kind, run.start() + m.start(), run.start() + m.end(), m[0])
                    for m in pattern.finditer(run[0]) if len(m[0]) >= LEAST[kind]]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates_of(least: int) -> re.Pattern:
    return re.compile(RUN + "{%d,}" % least)


SHORTEST = candidates_of(SHORTEST_EXAMPLE)


def other_candidates(text: str, known: list[tuple[str, int, int, str]], pattern: re.Pattern) -> list[tuple[int, int]]:
    """Spans of candidate tokens that no known span overlaps."""
    out, at = [], 0
    ends = sorted((start, end) for _, start, end, _ in known)
    for m in pattern.finditer(text):
        while at < len(ends) and ends[at][1] <= m.start():
            at += 1
        if not any(start < m.end() and end > m.start() for start, end in ends[at : at + len(KINDS)]):
            out.append(m.span())
    return out


@dataclass
class Automaton:
    """States with log probabilities of each kind of character, of the end, and their followers."""

    steps: list[list[float]]
    ends: list[float]
    follow: list[dict[int, int]]

    def likelihood(self, token: str) -> float:
        """Log likelihood per character; off the learnt paths every kind is equally unlikely."""
        state, total = 0, 0.0
        for c in token:
            kind = CLASS_OF[c]
            if state < 0:
                total += math.log(SMOOTHING) + EMITTED[kind]
                continue
            total += self.steps[state][kind] + EMITTED[kind]
            state = self.follow[state].get(kind, -1)
        total += self.ends[state] if state >= 0 else math.log(SMOOTHING)
        return total / (len(token) + 1)


class PrefixTree:
    """Counts of the prefixes of examples, folded into an automaton by merging states."""

    def __init__(self, examples: list[str]):
        self.next: list[dict[int, int]] = [{}]
        self.taken: list[dict[int, int]] = [{}]
        self.ended = [0]
        for word in examples:
            state = 0
            for c in word:
                kind = CLASS_OF[c]
                if kind not in self.next[state]:
                    self.next[state][kind] = len(self.next)
                    self.next.append({})
                    self.taken.append({})
                    self.ended.append(0)
                self.taken[state][kind] = self.taken[state].get(kind, 0) + 1
                state = self.next[state][kind]
            self.ended[state] += 1

    def passed(self, state: int) -> int:
        return self.ended[state] + sum(self.taken[state].values())

    def _alike(self, a: int, b: int, alpha: float) -> bool:
        """Hoeffding test of the two states and of all that follows them."""
        limit = math.sqrt(0.5 * math.log(2 / alpha))
        pairs, seen = [(a, b)], {(a, b)}
        while pairs:
            a, b = pairs.pop()
            n, m = self.passed(a), self.passed(b)
            gap = limit * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if gap >= 1:
                continue  # too rare to tell apart, and so is all that follows
            if abs(self.ended[a] / n - self.ended[b] / m) > gap:
                return False
            for kind in {*self.next[a], *self.next[b]}:
                if abs(self.taken[a].get(kind, 0) / n - self.taken[b].get(kind, 0) / m) > gap:
                    return False
                pair = self.next[a].get(kind), self.next[b].get(kind)
                if None not in pair and pair not in seen:
                    seen.add(pair)
                    pairs.append(pair)
        return True

    def _fold(self, into: int, tree: int) -> set[tuple[int, int]]:
        """Adds a subtree to a state and what follows it; returns the transitions that are new."""
        pairs, fresh = [(into, tree)], set()
        while pairs:
            into, tree = pairs.pop()
            self.ended[into] += self.ended[tree]
            for kind, child in self.next[tree].items():
                self.taken[into][kind] = self.taken[into].get(kind, 0) + self.taken[tree][kind]
                if kind in self.next[into]:
                    pairs.append((self.next[into][kind], child))
                else:
                    self.next[into][kind] = child
                    fresh.add((into, kind))
        return fresh

    def automaton(self, alpha: float = ALPHA) -> Automaton:
        """Merges states from the root outwards; a state alike to no settled one is settled itself."""
        settled = {0: 0}
        border = deque((0, kind) for kind in sorted(self.next[0]))
        while border:
            parent, kind = border.popleft()
            state = self.next[parent][kind]
            if state in settled:
                continue
            twin = next((s for s in settled if self._alike(s, state, alpha)), None)
            if twin is None:
                settled[state] = len(settled)
                border.extend((state, k) for k in sorted(self.next[state]))
            else:
                self.next[parent][kind] = twin
                border.extend(sorted(x for x in self._fold(twin, state) if x[0] in settled))
        steps, ends, follow = [], [], []
        for s in settled:
            whole = self.passed(s) + SMOOTHING * (len(CLASSES) + 1)
            share = lambda n, whole=whole: math.log((n + SMOOTHING) / whole)
            steps.append([share(self.taken[s].get(kind, 0)) for kind in range(len(CLASSES))])
            ends.append(share(self.ended[s]))
            follow.append({kind: settled[t] for kind, t in self.next[s].items()})
        return Automaton(steps, ends, follow)


@dataclass
class FormatModel:
    """An automaton for each kind of credential and one for other tokens, and the line of each kind."""

    kinds: dict[str, Automaton]
    other: Automaton | None
    lines: dict[str, float]
    # Candidates have as many characters as the labelled credentials, the shortest few percent left aside.
    least: int = 16

    def plain(self, token: str) -> float:
        return self.other.likelihood(token) if self.other else sum(EMITTED) / len(EMITTED)

    def rate(self, kind: str, token: str) -> float | None:
        """By how much the format of a kind is likelier per character; None if the kind had no example."""
        return self.kinds[kind].likelihood(token) - self.plain(token) if kind in self.kinds else None

    def score(self, token: str) -> float | None:
        """By how much a format of credentials is likelier per character; None below every line."""
        plain = self.plain(token)
        over = [s for kind, a in self.kinds.items() if (s := a.likelihood(token) - plain) >= self.lines[kind]]
        return max(over, default=None)


def least_length(credentials: dict[str, list[str]]) -> int:
    """Length that all labelled credentials but the shortest few percent reach; without any there are no candidates to speak of."""
    lengths = sorted(len(x) for examples in credentials.values() for x in examples)
    return lengths[len(lengths) * MISSED_PERCENT // 100] if lengths else LONGEST_EXAMPLE


def learn_formats(credentials: dict[str, list[str]], others: list[str], alpha: float = ALPHA) -> FormatModel:
    """Automata of the given examples; a kind without examples finds nothing."""
    least = least_length(credentials)
    other = PrefixTree(others).automaton(alpha) if others else None
    model = FormatModel({}, other, {}, least)
    for kind, examples in credentials.items():
        if not examples:
            continue
        learnt = PrefixTree(examples).automaton(alpha)
        scores = sorted(learnt.likelihood(x) - model.plain(x) for x in examples)
        # Never below zero: a token must look more like a credential than like other tokens.
        model.kinds[kind] = learnt
        model.lines[kind] = max(0.0, scores[len(scores) * MISSED_PERCENT // 100])
    return model


def _examples(batches):
    for batch in batches:
        rows = set()
        for text in batch.column(0):
            whole = text.as_py()
            known = base_spans(whole)
            rows.update((kind, secret) for kind, _, _, secret in known)
            rows.update((LEARNT, whole[start:end]) for start, end in other_candidates(whole, known, SHORTEST))
        rows = [r for r in rows if len(r[1]) <= LONGEST_EXAMPLE]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["kind", "token"])


def fit_formats(
    df: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, credentials: int = CREDENTIALS,
    other_tokens: int = OTHER_TOKENS, alpha: float = ALPHA,
) -> FormatModel:
    """Formats learnt from about ``sample_docs`` different texts, picked by the hash of their text.

    At most ``credentials`` different examples of a kind and ``other_tokens`` other tokens are used, picked
    by hash. Examples of over 256 characters teach nothing. The scan itself covers all rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    different = df.select(text).where(picked(["text"], sample_docs, df.count())).dropDuplicates(["text"])
    found = different.mapInArrow(_examples, "kind string, token string").distinct().persist()
    try:
        def examples(kind: str, most: int, least: int) -> list[str]:
            fit = found.where((F.col("kind") == kind) & (F.length("token") >= least))
            return sorted(r.token for r in fit.orderBy(F.xxhash64("token"), "token").limit(most).collect())

        by_kind = {kind: examples(kind, credentials, 1) for kind in KINDS}
        others = examples(LEARNT, other_tokens, least_length(by_kind))
    finally:
        found.unpersist()
    return learn_formats(by_kind, others, alpha)


def _scan(texts: pa.Array, model: FormatModel, memo: dict) -> pa.Array:
    kinds, starts, ends, scores, offsets = [], [], [], [], [0]
    pattern = candidates_of(model.least)
    for text in texts:
        whole = text.as_py()
        known = base_spans(whole)
        found = [(kind, start, end, model.rate(kind, secret)) for kind, start, end, secret in known]
        for start, end in other_candidates(whole, known, pattern):
            token = whole[start:end]
            if token not in memo:
                if len(memo) > MEMO_TOKENS:
                    memo.clear()
                memo[token] = model.score(token)
            if memo[token] is not None:
                found.append((LEARNT, start, end, memo[token]))
        # Of a learnt and a fixed span that begin at one place the fixed one comes first.
        for kind, start, end, score in sorted(found, key=lambda s: (s[1], [*KINDS, LEARNT].index(s[0]))):
            kinds.append(kind)
            starts.append(start)
            ends.append(end)
            scores.append(score)
        offsets.append(len(kinds))
    rows = pa.StructArray.from_arrays(
        [pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(scores, pa.float64())],
        names=["kind", "start", "end", "score"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


def secret_spans(df: DataFrame, model: FormatModel, text: Column) -> Column:
    """Spans of whole texts in code points, end exclusive, by start; a null text has none.

    ``score`` says by how much the format of credentials is likelier than that of other tokens, per character. Spans of the fixed
    patterns are all told, whatever their score; those of kind ``format`` are candidates that no fixed span overlaps
    and whose score reaches the line of a kind. Only a kind without labelled examples leaves its fixed spans unscored.
    """
    shared, memo = df.sparkSession.sparkContext.broadcast(model), {}

    def scan(texts: pa.Array) -> pa.Array:
        return _scan(texts, shared.value, memo)

    return F.arrow_udf(scan, SPANS).asNondeterministic()(F.coalesce(text.cast("string"), F.lit("")))


def scan_secrets(df: DataFrame, model: FormatModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``df``: ``id`` and ``spans``, an empty list where nothing is found.

    Null and repeated ids are rows like any other, a null text is empty, and an empty table gives no row. Texts are read whole,
    however long, and other columns do not matter.
    """
    return df.select(F.col(f"`{id_col}`").alias("id"), secret_spans(df, model, F.col(f"`{text_col}`")).alias("spans"))
