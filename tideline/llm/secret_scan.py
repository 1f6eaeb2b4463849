"""Secret scans: base patterns, and probabilistic automata inferred from the credentials that they label."""

from __future__ import annotations

import math
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import Scratch, documents, text_rows

# The contract's base patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so that shorter ones drop out
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"

SAMPLE = 2000  # labelled credentials a kind from which its automaton is inferred, those of least hash
ALPHA = 0.01  # significance of the merging test
RARE = 1e-3  # probability of a symbol that a state has not seen though the kind has
MARGIN = 1.0  # bits a symbol by which a format must beat ordinary strings, at least
LONGEST = 256  # longer credentials are taken into the sample last
SAMPLE_SYMBOLS = SAMPLE * LONGEST  # of a kind's sample: that bounds what the driver holds
BACK = 1e-3
CASE_BITS = 2.0  # cost of a word's being written in capitals


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of the base patterns, leftmost and non-overlapping for each kind."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return found


def free_candidates(text: str, base: list[tuple[str, int, int, str]]) -> list[re.Match]:
    """Candidate strings that no base span touches."""
    found = list(CANDIDATE.finditer(text))
    if not base:
        return found
    return [m for m in found if all(m.end() <= start or end <= m.start() for _, start, end, _ in base)]


class Automaton:
    """A deterministic probabilistic automaton; state 0 is the start."""

    def __init__(self, counts: list[dict[str, int]], stops: list[int], nexts: list[dict[str, int]]):
        self.alphabet = frozenset(c for x in counts for c in x)
        self.steps: list[dict[str, tuple[int, float]]] = []
        self.ends: list[float] = []
        for n, stop, to in zip(counts, stops, nexts):
            total = sum(n.values()) + stop
            self.steps.append({c: (to[c], math.log2(n[c] / total * (1 - RARE))) for c in n})
            self.ends.append(math.log2(max(stop / total, RARE)))
        self.rare = math.log2(RARE / max(1, len(self.alphabet)))

    def bits(self, word: str) -> float | None:
        """log2 probability of the word; None if it has a symbol that the format never has."""
        at, total = 0, 0.0
        for c in word:
            step = self.steps[at].get(c)
            if step is None:
                if c not in self.alphabet:
                    return None
                at, total = 0, total + self.rare
            else:
                at, total = step[0], total + step[1]
        return total + self.ends[at]


def infer(words: dict[str, int], alpha: float = ALPHA) -> Automaton | None:
    """Merge the states of the words' prefix tree while their futures do not differ significantly.

    The tree is walked breadth first. Each new state is folded into the first kept state whose stop and symbol
    frequencies agree, here and in all states below, within Hoeffding bounds; otherwise it is kept.
    """
    nexts: list[dict[str, int]] = [{}]
    counts: list[dict[str, int]] = [{}]
    stops = [0]
    for word in sorted(words):
        at = 0
        for c in word:
            counts[at][c] = counts[at].get(c, 0) + words[word]
            if c not in nexts[at]:
                nexts[at][c] = len(nexts)
                nexts.append({})
                counts.append({})
                stops.append(0)
            at = nexts[at][c]
        stops[at] += words[word]
    if not words:
        return None
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    size = lambda s: sum(counts[s].values()) + stops[s]

    def agree(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = size(a), size(b)
            if not na or not nb or a == b:
                continue
            most = bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if most >= 1:  # too few words to tell apart, here or below
                continue
            if abs(stops[a] / na - stops[b] / nb) > most:
                return False
            for c in counts[a].keys() | counts[b].keys():
                if abs(counts[a].get(c, 0) / na - counts[b].get(c, 0) / nb) > most:
                    return False
                if c in nexts[a] and c in nexts[b]:
                    todo.append((nexts[a][c], nexts[b][c]))
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            stops[a] += stops[b]
            for c, n in counts[b].items():
                counts[a][c] = counts[a].get(c, 0) + n
                if c in nexts[a]:
                    todo.append((nexts[a][c], nexts[b][c]))
                else:
                    nexts[a][c] = nexts[b][c]

    kept, queue = [0], deque((0, c) for c in sorted(nexts[0]))
    while queue:
        parent, c = queue.popleft()
        state = nexts[parent][c]
        if state in kept:
            continue
        like = next((k for k in kept if agree(k, state)), None)
        if like is None:
            kept.append(state)
            queue.extend((state, d) for d in sorted(nexts[state]))
        else:
            nexts[parent][c] = like
            before = set(nexts[like])
            fold(like, state)
            for k in kept:
                queue.extend((k, d) for d in sorted(nexts[k]) if nexts[k][d] not in kept and (k != like or d not in before))
    number = {s: k for k, s in enumerate(kept)}
    return Automaton([counts[s] for s in kept], [stops[s] for s in kept], [{c: number[t] for c, t in nexts[s].items()} for s in kept])


class Ordinary:
    """Symbol pairs of the candidates that no base pattern labels: what a format is held against.

    A pair's probability is smoothed by the second symbol's own share, with a weight of BACK of all symbols: so what
    follows a symbol that ordinary strings hardly have is not learnt from the few unlabelled credentials among them.
    """

    def __init__(self, pairs: dict[str, int]):
        starts: Counter[str] = Counter()
        ends: Counter[str] = Counter()
        for pair, n in pairs.items():
            starts[pair[0]] += n
            ends[pair[1]] += n
        size, whole = len(SYMBOLS) + 1, sum(starts.values())
        weight = max(1.0, BACK * whole)
        share = {c: (ends[c] + 0.5) / (whole + 0.5 * size) for c in SYMBOLS + "$"}
        self.pairs = {a + c: math.log2((pairs.get(a + c, 0) + weight * share[c]) / (starts[a] + weight)) for a in SYMBOLS + "^" for c in SYMBOLS + "$"}

    def bits(self, word: str) -> float:
        """log2 probability of the word, or of its being a lower-case one in capitals."""
        low = word.lower()
        return self._bits(word) if low == word else max(self._bits(word), self._bits(low) - CASE_BITS)

    def _bits(self, word: str) -> float:
        return sum(map(self.pairs.__getitem__, map(str.__add__, "^" + word, word + "$")))


def common_prefix(words) -> str:
    low, high = min(words), max(words)
    n = next((k for k, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    return low[:n]


def forms(word: str) -> set[str]:
    """The word, it in the other case if it has only one, and each without dashes: ways to write one credential."""
    found = {word}
    if word.upper() == word:
        found.add(word.lower())
    elif word.lower() == word:
        found.add(word.upper())
    return found | {plain for w in found if len(plain := w.replace("-", "").replace("_", "")) >= 12}


class Formats:
    """The automata, and for each the score from which on a candidate counts as that format.

    A kind whose credentials all begin alike (a cue of three symbols or more) gives a second format, of what follows.
    """

    def __init__(self, labelled: dict[str, dict[str, int]], pairs: dict[str, int]):
        self.ordinary = Ordinary(pairs)
        self.automata = []
        for kind in sorted(labelled):
            words = labelled[kind]
            cue = common_prefix(words) if len(words) > 1 else ""
            self._learn(kind, words)
            if len(cue) >= 3 and min(map(len, words)) >= len(cue) + 8:
                self._learn(f"{kind} without {cue}", {w[len(cue) :]: n for w, n in words.items()})

    def _learn(self, kind: str, words: dict[str, int]) -> None:
        if automaton := infer(words):
            scores = sorted(self.gain(automaton, w, w) for w in words)
            self.automata.append((kind, automaton, max(MARGIN, scores[len(scores) // 100] / 2)))  # halfway to even odds

    def gain(self, automaton: Automaton, form: str, word: str) -> float:
        """Bits a symbol by which the format explains a form of the word better than ordinary strings do the word."""
        bits = automaton.bits(form)
        return -math.inf if bits is None else (bits - self.ordinary.bits(word)) / (len(word) + 1)

    def matches(self, word: str) -> bool:
        return any(self.gain(automaton, form, word) >= least for form in forms(word) for _, automaton, least in self.automata)


def label_credentials(docs: DataFrame, sample: int = SAMPLE) -> Formats:
    """Formats from the whole corpus: base credentials label themselves, all other candidates are ordinary.

    Counting covers every text; from the distinct credentials of a kind the `sample` ones of least hash are used, those
    of at most LONGEST symbols first, as far as they have SAMPLE_SYMBOLS together. The table of counts is deleted once it
    has been read, or if that fails.
    """

    def gather(batches):
        held: Counter[tuple[str, str]] = Counter()
        pairs: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                base = base_spans(text)
                held.update((kind, secret) for kind, _, _, secret in base)
                for m in free_candidates(text, base):
                    word = f"^{m[0]}$"
                    pairs.update(map(str.__add__, word, word[1:]))
            if len(held) > 100_000:
                yield rows(held)
                held.clear()
        yield rows(held + Counter({("pair", p): n for p, n in pairs.items()}))

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.string()), pa.array([w for _, w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["kind", "word", "n"])

    scratch = Scratch(docs.sparkSession, "secret-formats")  # holds credentials in clear until they have been read
    order = [F.length("word") > LONGEST, F.xxhash64("word"), F.col("word")]
    try:
        counts = scratch.table(text_rows_only(docs).mapInArrow(gather, "kind string, word string, n long").groupBy("kind", "word").agg(F.sum("n").alias("n")), "counts")
        labelled = {}
        for kind in KINDS:
            drawn = counts.where(F.col("kind") == kind).orderBy(*order).limit(sample)
            drawn = drawn.withColumn("symbols", F.sum(F.length("word")).over(Window.orderBy(*order))).where(F.col("symbols") <= SAMPLE_SYMBOLS)  # `sample` rows
            labelled[kind] = {r.word: r.n for r in drawn.collect()}
        pairs = {r.word: r.n for r in counts.where("kind = 'pair'").collect()}  # at most (symbols + 2) squared rows
    finally:
        scratch.drop("counts")
    return Formats(labelled, pairs)


def text_rows_only(docs: DataFrame) -> DataFrame:
    return text_rows(docs).select("text")


def secret_scan(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """One row per document: doc_id, spans (array of kind, start, end in code points, by start and kind).

    Kinds: assign, access, hex (base patterns) and format (a candidate of 12 or more symbols outside all base spans
    whose likelihood under an inferred format beats that of ordinary strings by the format's margin). Null and empty
    texts have no spans; whole texts are scanned, however long; repeated rows are scanned each; without any labelled credential only base spans are found.
    """
    formats = formats or label_credentials(docs)
    order = {kind: k for k, kind in enumerate((*KINDS, "format"))}

    def scan(batches):
        known: dict[str, bool] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([spans(text, known) for text in part.column(1).to_pylist()], kind_spans)], ["doc_id", "spans"])
                if len(known) > 200_000:
                    known.clear()

    def spans(text, known):
        base = base_spans(text)
        found = [{"kind": kind, "start": start, "end": end} for kind, start, end, _ in base]
        for m in free_candidates(text, base):
            word = m[0]
            if word not in known:
                known[word] = formats.matches(word)
            if known[word]:
                found.append({"kind": "format", "start": m.start(), "end": m.end()})
        return sorted(found, key=lambda s: (s["start"], order[s["kind"]]))

    kind_spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return text_rows(docs).mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s.kind != "format")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(of(k) for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), of("format"))
