"""Toxicity scores on deobfuscated text.

A noisy channel restores words that were disguised: letters written as look-alike
digits and signs, letters drawn out, letters kept apart by spaces or marks.  The readings of a
disguised word form a lattice of characters; Viterbi decoding under a character trigram
model, counted over the whole corpus, picks the likeliest reading.  Restored words, and
their first letters, are then weighed by how labelled toxic and clean documents differ in
them.

The classifier is fitted on at most ``SAMPLE`` labelled rows, those with the least hash
among rows whose ``crc32(doc_id)`` mod 5 is not 0.  Evidence counts by distinct contexts (the
word before), so that copies of one document count once.  The lexicon holds every word of the
sample with enough evidence; words of any length are decoded.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, lean, materialize, new_folder, open_fs, small_batches, without_ids

#: Labelled rows the classifier is fitted on at most.
SAMPLE = 12_000
#: Beginnings of words that count as evidence beside the words.
PREFIXES = (4, 5)
#: Share of toxic texts taken to be without known evidence, beyond those counted.
UNSEEN = 0.02
#: What a sign may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a",
              "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i", "*": "aeiou", "#": "h"}
_SIGNS = {c for c in LOOKALIKES if not c.isdigit()}
_MARKS = set("._-~^*'’`·•/\\|,:;​‌‍\xad")
_EDGE = ".,;:?\"'()[]{}«»“”„…!-_*~"
#: Words whose weight a worker remembers; different words whose characters wait to be counted.
_MEMO_WORDS, _HELD_WORDS = 200_000, 60_000
#: Trigrams whose probability a worker remembers; bits of a character in a packed trigram.
_MEMO_GRAMS, _CHAR = 100_000, (1 << 21) - 1
_START, _STOP = "\x02", "\x03"
#: Log-cost of one disguise.
_SWAP, _DROP, _REPEAT = -1.5, -1.0, -0.5


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    uniq, place = np.unique(keys, return_inverse=True)
    out = np.zeros(len(uniq), np.int64)
    np.add.at(out, place, n)
    return uniq, out


def _count(table: tuple[np.ndarray, np.ndarray], key: int) -> int:
    keys, n = table
    i = int(keys.searchsorted(key))
    return int(n[i]) if i < len(keys) and keys[i] == key else 0


def slots(word: str) -> Iterator[list[tuple[str, float]]]:
    """What each run of one character in a (lower-case) word may stand for, with the log-cost."""
    i = 0
    while i < len(word):
        c, j = word[i], i
        while j < len(word) and word[j] == c:
            j += 1
        run = j - i
        if c.isalpha():
            yield [(c, 0.0 if run == 1 else _REPEAT)] + ([(c * 2, 0.0 if run == 2 else _REPEAT)] if run > 1 else [])
        else:
            options = [(x, _SWAP) for x in LOOKALIKES.get(c, "")]
            if run > 1:
                options += [(x * 2, _SWAP * 2) for x in LOOKALIKES.get(c, "")]
            if c in _MARKS or not options:
                options.append(("", _DROP))
            yield options
        i = j


class CharModel:
    """Interpolated character trigram model of all trigrams in ``folder`` (Parquet, ``gram, n``).

    Only the name of the folder travels; each worker loads the table once, 16 bytes a trigram and less for bigrams.
    """

    def __init__(self, folder: str):
        self.folder, self.known = folder, {}

    def __getstate__(self):
        return {"folder": self.folder, "known": {}}

    def tables(self) -> tuple:
        """Counts of trigrams, their contexts, bigrams, their contexts and characters, and the total."""
        return keep("toxicity", self.folder, self._load)

    def _load(self) -> tuple:
        from pyarrow import fs as pafs, parquet

        fs, path = open_fs(self.folder)
        keys, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for info in fs.get_file_info(pafs.FileSelector(path)):
            if info.base_name.endswith(".parquet") and info.base_name[0] not in "._":
                with fs.open_input_file(info.path) as file:
                    part = parquet.ParquetFile(file).read()
                keys.append(part.column("gram").to_numpy())
                n.append(part.column("n").to_numpy())
        tri = _sums(np.concatenate(keys), np.concatenate(n))
        k, n = tri
        uni = _sums(k & _CHAR, n)
        return tri, _sums(k >> 21, n), _sums(k & (1 << 42) - 1, n), _sums(k >> 21 & _CHAR, n), uni, int(n.sum()) or 1

    def log_p(self, a: str, b: str, c: str) -> float:
        known = self.known.get(a + b + c)
        if known is None:
            tri, ctx2, bi, ctx1, uni, total = self.tables()
            x, y, z = ord(a), ord(b), ord(c)
            p = (0.7 * _count(tri, x << 42 | y << 21 | z) / max(1, _count(ctx2, x << 21 | y))
                 + 0.2 * _count(bi, y << 21 | z) / max(1, _count(ctx1, y)) + 0.0999 * _count(uni, z) / total + 1e-6)
            if len(self.known) >= _MEMO_GRAMS:
                self.known.clear()
            self.known[a + b + c] = known = math.log(p)
        return known

    def log_word(self, word: str) -> float:
        """Log-probability of a word's characters."""
        x = f"{_START}{_START}{word}{_STOP}"
        return sum(self.log_p(*x[i:i + 3]) for i in range(len(x) - 2))

    def restore(self, word: str) -> str:
        """Likeliest reading of a (lower-case) word by Viterbi decoding of its lattice."""
        return self.decode(word, None)

    def decode(self, word: str, longest: int | None) -> str:
        """As :meth:`restore`; with ``longest`` the reading may be cut behind so many characters, and decoding ends
        as soon as all readings that are left have those characters in common."""
        states: dict[tuple[str, str], tuple[float, tuple | None]] = {(_START, _START): (0.0, None)}
        heads: dict[tuple[str, str], str] = {(_START, _START): ""}
        for options in slots(word):
            nxt: dict[tuple[str, str], tuple[float, tuple | None]] = {}
            head: dict[tuple[str, str], str] = {}
            for (a, b), (score, back) in states.items():
                start = heads[a, b]
                for emit, cost in options:
                    x, y, s = a, b, score + cost
                    for ch in emit:
                        s += self.log_p(x, y, ch)
                        x, y = y, ch
                    if (x, y) not in nxt or s > nxt[x, y][0]:
                        nxt[x, y] = (s, (back, emit) if longest is None else None)
                        head[x, y] = start if longest is None or len(start) >= longest else start + emit
            states, heads = nxt, head
            if longest is not None and len(set(heads.values())) == 1 and len(next(iter(heads.values()))) >= longest:
                return next(iter(heads.values()))
        end = max(states, key=lambda k: states[k][0] + self.log_p(*k, _STOP))
        if longest is not None:
            return heads[end]
        parts, back = [], states[end][1]
        while back is not None:
            back, emit = back
            parts.append(emit)
        return "".join(reversed(parts))


_PLAIN = re.compile(r"[^\W\d_]+\Z")
_DRAWN = re.compile(r"(.)\1\1")


def disguised(word: str) -> bool:
    """Whether a word (stripped, lower-case) has letters together with signs, or drawn-out letters, or is made of signs one
    of which looks like a letter and is no digit."""
    if _PLAIN.match(word):
        return bool(_DRAWN.search(word))
    return any(c.isalpha() or c in _SIGNS for c in word)


@dataclass
class Model:
    """What is broadcast: bounded by the words of ``SAMPLE`` labelled rows, as the character model is a table in the shared folder."""

    chars: CharModel
    weights: dict[str, float]
    bias: float

    def readings(self, raw: str, longest: int | None = None) -> list[str]:
        """The word as it stands and, if it looks disguised, as restored (see :meth:`CharModel.decode`)."""
        word = raw.strip(_EDGE)
        out = [word] if word else []
        if word and disguised(word):
            out.append(self.chars.decode(word, longest))
            if raw[-1:] == "!" or raw[:1] in "!*":
                out.append(self.chars.decode(raw.strip(".,;:?\"'()[]{}"), longest))
        return out

    def longest(self) -> int:
        """Characters of a reading that can matter: one more than the longest word of the lexicon has."""
        return max([*map(len, self.weights), *PREFIXES]) + 1

    def weight(self, raw: str, longest: int | None = None) -> float:
        best = 0.0
        for word in self.readings(raw, longest):
            for f in features(word):
                best = max(best, self.weights.get(f, 0.0))
        return best


def features(word: str) -> list[str]:
    """The word itself and its beginnings (marked by an asterisk)."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


class Spaced:
    """Words of the lexicon that stand in a text with spaces inside.

    A walk along the tokens (without edge punctuation) keeps the readings that begin a word of the lexicon.  A
    word that ends with a token counts if the characters decode to it, and if the character model prefers it,
    less the cost of the dropped spaces, to the tokens as words; three or more single characters need no comparison.
    """

    def __init__(self, model: Model):
        self.model = model
        self.words = {w for w in model.weights if len(w) > 2 and not w.endswith("*")}
        self.heads = {w[:n] for w in self.words for n in range(1, len(w) + 1)}

    @staticmethod
    def token(raw: str) -> str:
        """The token without edge punctuation (a single sign stays)."""
        return raw.strip(_EDGE) or (raw if len(raw) == 1 else "")

    def start(self, raw: str) -> dict[str, str]:
        """Readings of a token that begin a word of the lexicon, with the characters they read."""
        return {x: y for x, y in self.grown({"": ""}, self.token(raw)).items() if x}

    def grown(self, states: dict[str, str], token: str) -> dict[str, str]:
        """``states`` (a reading and the characters it reads) after another token."""
        out = dict(states) if not token or token in _EDGE else {}
        for read, raw in states.items():
            rest = token.lstrip(raw[-1]) if raw and token[:1] == raw[-1] and raw[-1].isalpha() else token
            for part in {token, rest}:
                reads = [read]
                for options in slots(part):
                    if not reads:
                        break
                    reads = [x + emit for x in reads for emit, _ in options if not x + emit or x + emit in self.heads]
                for x in reads:
                    out.setdefault(x, raw + token)
        return out

    def may_grow(self, states: dict[str, str], token: str) -> bool:
        """Whether :meth:`grown` can keep a state, by the token's first character alone."""
        if not token or token in _EDGE:
            return True
        c = token[0]
        if not c.isalpha():
            return True
        heads = self.heads
        for read, raw in states.items():
            if read + c in heads or raw and raw[-1] == c:
                return True
        return False

    def accepted(self, word: str, raw: str, tokens: list[str]) -> bool:
        chars = self.model.chars
        if raw != word and (not any(c.isalpha() for c in raw) or chars.restore(raw) != word):
            return False
        if len(tokens) > 2 and all(len(t) == 1 for t in tokens):
            return True
        apart = sum(chars.log_word(chars.restore(t) if disguised(t) else t) for t in tokens)
        return chars.log_word(word) + _DROP * (len(tokens) - 1) > apart

    def evidence(self, words: list[str], start: Callable[[str], dict[str, str]] | None = None) -> float:
        """Largest sum over words that share no token; each different word counts once.  ``start`` may remember :meth:`start`."""
        start = start or self.start
        ends: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for i, first in enumerate(words):
            states = start(first)
            if not states or i and first == words[i - 1] and len(first) == 1:  # a drawn-out letter is read from its first
                continue
            tokens, j = [self.token(first)], i
            while states and j + 1 < len(words):
                j += 1
                token = self.token(words[j])
                if not self.may_grow(states, token):
                    break
                states = {x: y for x, y in self.grown(states, token).items() if x}
                tokens += [token] if token else []
                for x, raw in states.items():
                    if token and x in self.words and raw.endswith(token) and self.accepted(x, raw, tokens):
                        ends[j + 1].append((i, x))
        if not ends:
            return 0.0
        best: list[tuple[float, frozenset[str]]] = [(0.0, frozenset())]
        for j in range(1, len(words) + 1):
            top = best[-1]
            for i, x in ends.get(j, ()):
                score, used = best[i]
                score += 0.0 if x in used else self.model.weights[x]
                top = max(top, (score, used | {x}), key=lambda p: p[0])
            best.append(top)
        return best[-1][0]


class _Memo(dict):
    """Weights of words; a word that begins a word of the lexicon, alone or behind a disguise, has its readings beside it."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.spaced, self.longest = model, Spaced(model), model.longest()

    def __missing__(self, raw: str) -> float | tuple[float, dict[str, str]]:
        if len(self) >= _MEMO_WORDS:
            self.clear()
        weight, states = self.model.weight(raw, self.longest), self.spaced.start(raw)
        self[raw] = out = (weight, states) if states else weight
        return out

    def weight(self, raw: str) -> float:
        v = self[raw]
        return v if type(v) is float else v[0]

    def start(self, raw: str) -> dict[str, str] | None:
        v = self[raw]
        return None if type(v) is float else v[1]


def score_text(text: str | None, model: Model, memo: _Memo) -> float:
    """Probability of label 1: prior and the evidence of each different word, and of words with spaces inside."""
    words = (text or "").lower().split()
    x = model.bias
    for w in set(words):
        x += memo.weight(w)
    x += memo.spaced.evidence(words, memo.start)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def character_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``gram, n``: trigrams (21 bits a character) of the words of all texts, counted in the tasks before the shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words: Counter = Counter()
        grams: Counter = Counter()

        def spill() -> None:
            plain = [w for w in words if w]
            if not plain:
                return
            text = "".join(f"{_START}{_START}{w}{_STOP}" for w in plain)
            codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
            weight = np.repeat(np.array([words[w] for w in plain]), [len(w) + 3 for w in plain])
            key = codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]
            inside = (codes[:-2] != 3) & (codes[1:-1] != 3)
            uniq, place = np.unique(key[inside], return_inverse=True)
            for k, n in zip(uniq.tolist(), np.bincount(place, weight[:-2][inside]).tolist()):
                grams[k] += int(n)
            words.clear()

        for b in batches:
            for t in b.column(0):
                text = t.as_py()
                if text:
                    words.update(w.strip(_EDGE) for w in text.lower().split())
            if len(words) > _HELD_WORDS:
                spill()
        spill()
        yield pa.RecordBatch.from_pydict({"gram": pa.array(list(grams), pa.int64()), "n": pa.array(list(grams.values()), pa.int64())})

    counted = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(lean("toxicity", run), "gram long, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def _training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """``text, toxic`` of the sample: the labelled training rows with the least hash of their id."""
    own = labels.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`toxic`").cast("int").alias("toxic"))
    own = own.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return materialize(text.join(F.broadcast(own), "doc_id").select("text", "toxic"), "labelled")


def _gather(rows: DataFrame, chars: CharModel, only: set[str] | None) -> DataFrame:
    """Evidence of ``rows``: ``feature, docs`` and, without ``only``, ``contexts`` (distinct words before it)."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((chars, only))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model, wanted = shared.value
        reader = Model(model, {}, 0.0)
        longest = None if wanted is None else max([*map(len, wanted), *PREFIXES]) + 1
        memo: dict[str, list[str]] = {}
        docs: Counter = Counter()
        seen: dict[str, set[str]] = defaultdict(set)
        n_docs = n_words = 0
        for b in batches:
            for t in b.column(0):
                words = (t.as_py() or "").lower().split()
                n_docs, n_words = n_docs + 1, n_words + len(words)
                found: set[str] = set()
                before = ""
                for w in words:
                    fs = memo.get(w)
                    if fs is None:
                        fs = memo[w] = [f for r in reader.readings(w, longest) for f in features(r) if wanted is None or f in wanted]
                    if fs:
                        found.update(fs)
                        if wanted is None:
                            for f in fs:
                                seen[f].add(before)
                    before = w
                docs.update(found)
        rows_ = [(f, n, None) for f, n in docs.items()] if wanted is not None else [(f, 0, c) for f, cs in seen.items() for c in cs] + [
            (f, n, None) for f, n in docs.items()]
        rows_.append((_START, n_docs, None))
        rows_.append((_STOP, n_words, None))
        f, n, c = zip(*rows_)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(f, pa.string()), "docs": pa.array(n, pa.int64()), "context": pa.array(c, pa.string())})

    found = rows.select("text").mapInArrow(lean("toxicity", run), "feature string, docs long, context string")
    return found.groupBy("feature").agg(F.sum("docs").alias("docs"), F.countDistinct("context").alias("contexts"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sample: int = SAMPLE) -> Model:
    """Character model of all texts, and the lexicon of the labelled sample."""
    small_batches(docs.sparkSession)
    folder = new_folder(docs.sparkSession, "trigrams")
    character_counts(docs, text_col).write.parquet(folder)
    chars = CharModel(folder)
    rows = _training_rows(docs, labels, id_col, text_col, sample)
    toxic, clean = rows.where("toxic = 1"), rows.where("toxic <> 1")
    kind = F.col("feature").isin(_START, _STOP)
    top = _gather(toxic, chars, None).where(kind | (F.col("contexts") >= 6))
    pos = {r["feature"]: (r["docs"], r["contexts"]) for r in top.collect()}
    neg = {r["feature"]: r["docs"] for r in _gather(clean, chars, set(pos)).collect()}
    n_pos, n_neg = pos.pop(_START, (0, 0))[0], neg.pop(_START, 0)
    w_pos, w_neg = pos.pop(_STOP, (0, 0))[0], neg.pop(_STOP, 0)
    if not n_pos:
        return Model(chars, {}, math.log(0.5 / (n_neg + 1)))
    # a toxic word stands in more contexts than the toxic share of all words explains
    rarity = -math.log((w_pos + 1) / (w_pos + w_neg + 2))
    weights = {}
    for f, (docs_with, contexts) in pos.items():
        llr = math.log((docs_with + 0.5) / (n_pos + 1)) - math.log((neg.get(f, 0) + 0.5) / (n_neg + 1))
        if docs_with >= 2 and llr >= 2.5 and neg.get(f, 0) * 5 <= docs_with and contexts * rarity - 4 * neg.get(f, 0) >= 20:
            weights[f] = llr
    model = Model(chars, weights, 0.0)
    # a share of toxic texts may show no known evidence even if no training row does
    model.bias = math.log((_count_missed(toxic, model) + UNSEEN * n_pos + 0.5) / (n_neg + 1))
    return model


def _count_missed(toxic: DataFrame, model: Model) -> int:
    """Toxic training rows without any evidence: the prior of a text that has none."""
    shared = toxic.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        memo, n = _Memo(shared.value), 0
        for b in batches:
            n += sum(not any(memo.weight(w) for w in set((t.as_py() or "").lower().split())) for t in b.column(0))
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return toxic.select("text").mapInArrow(lean("toxicity", run), "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row; a null or empty text gets the score of a text without evidence."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = shared.value
        memo = _Memo(own)
        for b in batches:
            out = [score_text(t.as_py(), own, memo) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return own.mapInArrow(lean("toxicity", run), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted`` (1 from a score of 0.5).

    Whole texts are scored; labels, language, source and id are no inputs.  Repeated rows get equal
    scores.  Without labels the score is that of no evidence; an empty table gives an empty result.
    If an id has several labels the largest counts; null ids or labels are not learned from.
    """
    x = score(docs, fit(docs, labels, id_col, text_col, sample=sample), id_col, text_col)
    return x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with a score below 0.5, with all columns."""
    lost = toxicity(docs, labels, id_col, text_col, **options).where("predicted = 1")
    return without_ids(docs, lost, id_col)
