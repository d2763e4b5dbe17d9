"""Toxicity: a noisy-channel decoder restores disguised words, and learned terms score the restored text.

Three jobs: character counts over all documents give the language model; a bounded sample of labelled
documents gives the terms; then every document is restored and scored where it lies, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import ROW, frugal, slices, table
from lorebase.llm.labelled import remainder, sample
from lorebase.workers import ship

#: The letters of the language model (0: no letter, last: any other letter) ...
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøœùúûüýÿß"
#: ... and the letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "€": "e", "(": "c", "£": "l"}
#: Signs that may stand between the letters of one word.
BETWEEN = " .-_*~/\\'`,:"
N = len(LETTERS) + 2
_CODES = np.zeros(0x250, np.int64)
for _i, _c in enumerate(LETTERS, 1):
    _CODES[ord(_c)] = _i
for _o in range(0x250):
    if chr(_o).isalpha() and not _CODES[_o]:
        _CODES[_o] = N - 1

#: Costs, as negative logarithms, of a sign for a letter, of a letter written again, of a sign between letters.
COST_SIGN, COST_AGAIN, COST_BETWEEN, COST_UNKNOWN = 1.0, 1.5, 0.5, 6.0
#: Longer tokens are keys or links rather than words: they are taken in pieces of this many characters.
LONGEST = 48
_OTHER = re.compile("[^\x00-\u00ff]")
TRIPLE = re.compile(r"[^\W\d_]*([^\W\d_])\1\1[^\W\d_]*")
#: Signs that end a plain word, and those that may precede it.
TRAILING, LEADING = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "!\"#%&'()*,-./:;<=>?[\\]^_`{}~"
#: What may stand for a letter, what may stand between two, and letters (each once or again and again) set apart.
SIGNS = "".join(c for c in LEET if not c.isalnum())
_UNIT, _GAP = f"(?:[^\\W_]|[{re.escape(SIGNS)}])", f"[\\s{re.escape(BETWEEN)}]+"
SPACED = re.compile(rf"(?<![^\W_])(?:({_UNIT})\1*{_GAP}){{3,}}({_UNIT})\2*(?![^\W_])")
GAP, AGAIN = re.compile(_GAP), re.compile(r"(.)\1{2,}")
#: What cannot belong to a word at a token's ends.
OUTER = "".join(c for c in TRAILING if c not in SIGNS) + "“”‘’«»„…"
EDGES = re.compile(r"^[^\w@$|€£+]+|[^\w]+$")
#: Prefixes of these lengths and whole words are terms; a term needs this posterior to count as a hit.
PREFIXES, LEAST = (4, 5, 6), 0.65
#: Weight of the prior in a term's posterior, in documents, and its mean.
PRIOR, PRIOR_MEAN = 3.0, 0.1
#: Contexts of a term that a document counts at most.
MOST_OF_DOC = 3
#: Bytes of text counted at once.
TEXT = 400_000
#: Least evidence for a term, in nats beyond the logarithm of the number of terms, against its being spread over both classes alike.
SURPRISE = 2.0


def codes(text: str) -> np.ndarray:
    """Letter numbers of a lower-cased text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _CODES[np.minimum(points, 0x24F)]
    out[(points >= 0x250)] = N - 1
    return out


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts (N, N, N) of letter trigrams in the lower-cased texts of all rows, boundaries included.

    Each task counts its rows into one array of fixed size and sends what is not 0; the table that comes to
    the driver has N**3 rows at most, whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**3, np.int64)
        for batch in slices(batches, most=TEXT):
            texts = [t.lower() for t in batch.column(0).to_pylist() if t]
            if texts:  # two blanks part the texts: no trigram has letters of both
                c = codes(f" {'  '.join(texts)} ")
                total += np.bincount((c[:-2] * N + c[1:-1]) * N + c[2:], minlength=N**3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": found, "n": total[found]}, pa.schema([("gram", pa.int64()), ("n", pa.int64())]))

    ship(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(frugal(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(N**3, np.float64)
    out[rows["gram"].to_numpy(np.int64)] = rows["n"]
    return out.reshape(N, N, N)


def log_model(counts: np.ndarray) -> np.ndarray:
    """-log P(letter | two before), smoothed by the bigrams."""
    pair = counts.sum(axis=0) + 0.1
    pair /= pair.sum(axis=1, keepdims=True)
    before = counts.sum(axis=2, keepdims=True)
    return -np.log((counts + 5.0 * pair[None]) / (before + 5.0)).astype(np.float32)


class Restorer:
    """Finds disguised words and decodes each along the cheapest path through its lattice of letters."""

    def __init__(self, costs: np.ndarray, longest: int = 16) -> None:
        """``longest``: letters of the longest term; pieces of a long token overlap so far that no term is cut."""
        self.costs, self.known, self.longest = costs, {}, longest

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each sign what it may stand for and at what cost; '' stands for nothing."""
        out: list[list[tuple[str, float]]] = []
        last = ""  # the sign before, across what may stand between
        for c in token:
            again, last = c == last, last if c in BETWEEN else c
            if c.isalpha():
                options = [(c, 0.0)]
                if again:
                    options.append(("", COST_AGAIN))
            else:
                options = [(x, COST_SIGN) for x in LEET.get(c, "")]
                if c in BETWEEN:
                    options.append(("", COST_BETWEEN))
                if again and options:
                    options.append(("", COST_AGAIN))
            out.append(options or [("", COST_UNKNOWN)])
        return out

    def decode(self, token: str) -> str:
        """The likeliest letters behind ``token`` (Viterbi; a state is the last two letters)."""
        if token in self.known:
            return self.known[token]
        lm, code = self.costs, {}
        paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for options in self.lattice(token):
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, said) in paths.items():
                for letter, extra in options:
                    if letter:
                        c = code.get(letter)
                        if c is None:
                            c = code[letter] = int(codes(letter)[0])
                        state, total = (b, c), cost + extra + float(lm[a, b, c])
                    else:
                        state, total = (a, b), cost + extra
                    if state not in after or total < after[state][0]:
                        after[state] = (total, said + letter)
            paths = after
        best = min(paths.items(), key=lambda x: (x[1][0] + float(lm[x[0][0], x[0][1], 0]), x[1][1]))[1][1]
        if len(self.known) > 50_000:
            self.known = {}
        self.known[token] = best
        return best

    def words(self, text: str) -> list[str]:
        """The words of a lower-cased text in order: letters alone as they are, disguised ones restored."""
        out = []
        tokens = text.split()
        for token in tokens:
            if token.isalpha():
                out.append(token)
            else:
                out += self.of_token(token)
        return out + self.joined(text, tokens)

    def of_token(self, token: str) -> list[str]:
        """The word, or words, of a token that is not letters alone."""
        plain = token.rstrip(TRAILING).lstrip(LEADING)
        if plain.isalpha():
            return [plain]
        token = EDGES.sub("", token)
        if token.isalpha():
            return [token]
        if len(token) < 3 or not any(c.isalpha() for c in token):
            return []
        return [self.decode(p) for p in self.pieces(token, LONGEST, 2 * self.longest)] + re.findall(r"[^\W\d_]{3,}", token)

    def with_ends(self, token: str) -> str:
        """A token decoded with the signs at its ends, which of_token takes for punctuation; '' where there are none."""
        core = token.strip(OUTER)
        if not 3 <= len(core) <= LONGEST or core[0] not in SIGNS and core[-1] not in SIGNS or not any(c.isalpha() for c in core):
            return ""
        return self.decode(core)

    @staticmethod
    def pieces(token: str, size: int, overlap: int) -> list[str]:
        """Pieces of ``size`` characters, or more where two overlaps need them."""
        size = max(size, 2 * overlap)
        return [token[i : i + size] for i in range(0, max(len(token) - overlap, 1), size - overlap)]

    def joined(self, text: str, tokens: list[str] | None = None) -> list[str]:
        """Words written with letters again and again, or with signs between their letters.

        Plain searches tell first whether a text can hold any, since few do.
        """
        out = []
        letters = LETTERS if text.isascii() or not _OTHER.search(text) else set(text)
        if any(c * 3 in text for c in letters):
            for m in TRIPLE.finditer(text):
                out += [self.decode(p) for p in self.pieces(AGAIN.sub(r"\1\1\1", m[0]), LONGEST, 3 * self.longest)]
        # Two tokens side by side that each may be one letter, or begin with letters set apart.
        if b"\1\1" in bytes([len(t) < 2 or t[0] == t[1] or not t[:2].isalnum() for t in (text.split() if tokens is None else tokens)]):
            for m in SPACED.finditer(text):
                out += [self.decode(p) for p in self.pieces(AGAIN.sub(r"\1\1\1", GAP.sub(" ", m[0])), 4 * LONGEST, 6 * self.longest)]
        return out


class Scorer:
    """Noisy-or of the posteriors of the distinct hit words."""

    def __init__(self, terms: dict[str, float], base: float) -> None:
        self.terms, self.base = terms, base
        self.starts = {t[1:4] for t in terms}
        self.whole = [(t[1:], p) for t, p in terms.items() if t[0] == "=" and len(t) > 4]

    def of_word(self, word: str) -> float:
        found = [p for p in (self.terms.get("^" + word[:n]) for n in PREFIXES if len(word) >= n) if p]
        if p := self.terms.get("=" + word):
            found.append(p)
        return max(found, default=0.0)

    def inside(self, word: str) -> dict[str, float]:
        """The term of a decoded string, else the likeliest one inside it, since several words may run together."""
        if p := self.of_word(word):
            return {word: p}
        p, t = max(((p, t) for t, p in self.whole if t in word), default=(0.0, "")) if len(word) > 6 else (0.0, "")
        return {t: p} if p else {}

    def hits(self, text: str, restorer: Restorer) -> dict[str, float]:
        out, starts = {}, self.starts
        tokens = text.split()
        for token in set(tokens):
            if token.isalpha():
                if token[:3] in starts and (p := self.of_word(token)):
                    out[token] = p
                continue
            found: dict[str, float] = {}
            for word in restorer.of_token(token):
                found |= self.inside(word)
            if not found and (word := restorer.with_ends(token)):
                found = self.inside(word)
            out |= found
        for word in restorer.joined(text, tokens):
            for w, p in self.inside(word).items():
                out[w] = max(p, out.get(w, 0.0))
        return out

    def score(self, hits: dict[str, float]) -> float:
        clean = math.prod(1 - p for p in hits.values())
        return min(1.0, max(0.0, 1 - clean * (1 - self.base)))


def train(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = (8_000, 2_000), of: int = 3, held: int = 1) -> tuple[np.ndarray, dict[str, float], float]:
    """Language model costs, terms with posteriors, and the score of a text without hits.

    The language model counts all documents. Terms come from about ``most`` clean and toxic labelled rows at
    most (remainder ``held`` of the id never). A term counts its contexts (words before it) in
    documents, three of a document at most, and each context stands for one document only, so that neither a
    long document nor its copies weigh more than others. Without labelled rows there are no terms, and the base is 0.05.
    """
    costs = log_model(trigram_counts(docs))
    shared = docs.sparkSession.sparkContext.broadcast(costs)
    rows, (n_clean, n_toxic) = sample(docs.select("doc_id", "text"), labels, "toxic", of, held, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in slices(batches):
            for text, y, doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = [w for w in restorer.words((text or "").lower()) if len(w) >= 3]
                pairs = list(set(zip(["", *words], words, strict=False)))
                yield pa.RecordBatch.from_pydict({"before": [a for a, _ in pairs], "word": [b for _, b in pairs], "y": [y] * len(pairs), "doc": [doc] * len(pairs)}, pa.schema([("before", pa.string()), ("word", pa.string()), ("y", pa.int32()), ("doc", pa.int64())]))

    pairs = rows.select("text", "y", F.xxhash64("text").alias("doc")).mapInArrow(frugal(run), "before string, word string, y int, doc long")
    contexts = pairs.groupBy(F.xxhash64("before", "word").alias("h"), "word").agg(F.min(F.shiftleft("doc", 1).bitwiseOR(F.col("y").cast("long"))).alias("doc")).select("word", "doc", F.col("doc").bitwiseAND(F.lit(1)).alias("y"))
    word = F.col("word")
    grams = F.array(F.concat(F.lit("="), word), *(F.when(F.length(word) >= n, F.concat(F.lit("^"), F.substring(word, 1, n))) for n in PREFIXES))
    of_doc = contexts.select(F.explode(F.array_compact(grams)).alias("term"), "doc", "y").groupBy("term", "doc", "y").agg(F.least(F.count("*"), F.lit(MOST_OF_DOC)).alias("n"))
    counts = of_doc.groupBy("term").agg(F.sum(F.col("n") * F.col("y")).alias("t"), F.sum("n").alias("n"), F.sum("y").alias("docs"))
    counts = table(counts, "toxic-terms")
    share, n_terms = counts.agg(F.coalesce(F.sum("t") / F.sum("n"), F.lit(0.0)), F.count("*")).first()
    share = min(max(share, 1e-6), 1 - 1e-6)
    rate = F.col("t") / F.col("n")
    surprise = F.col("n") * (rate * F.log(rate / share) + F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - share))).otherwise(0.0))
    posterior = (F.col("t") + PRIOR * PRIOR_MEAN) / (F.col("n") + PRIOR)
    terms = counts.where((F.col("docs") >= 3) & (posterior >= LEAST) & (surprise >= math.log(n_terms + 1) + SURPRISE)).select("term", posterior.alias("p"))
    # No more than a third of the sample's distinct words, which ``most`` bounds, can be terms.
    found = dict(terms.orderBy(F.col("p").desc(), "term").toPandas().itertuples(index=False))
    base = 0.05 if not n_toxic else min(0.3, 0.5 * n_toxic / (n_toxic + n_clean))
    return costs, found, base


def _scores(docs: DataFrame, labels: DataFrame, of: int, held: int, most: tuple[int, int]):
    """A function of a list of texts that gives (score, hits) of each, for use in tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most, of, held))

    def judge():
        costs, terms, base = shared.value
        restorer, scorer = Restorer(costs, max((len(t) - 1 for t in terms), default=16)), Scorer(terms, base)

        def of_texts(texts: list[str | None]) -> list[tuple[float, int]]:
            hits = [scorer.hits(t.lower(), restorer) if t else {} for t in texts]
            return [(scorer.score(h), len(h)) for h in hits]

        return of_texts

    return judge


def score(docs: DataFrame, labels: DataFrame, of: int = 3, held: int = 1, threshold: float = 0.7, most: tuple[int, int] = (8_000, 2_000), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and n_hits (distinct toxic words) of every whole text.

    Null and empty texts have no hits and get the base score; a null id is not held out; repeated rows are
    scored alike; an empty table gives no rows; other columns are left out.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    judge = _scores(slim, labels, of, held, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_texts = judge()
        for batch in slices(batches, 2):
            found = of_texts(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int32())], ["doc_id", "held_out", "score", "n_hits"])

    rows = slim.select("doc_id", (remainder(F.col("doc_id"), of) == held).alias("held_out"), "text")
    out = rows.mapInArrow(frugal(run), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, n_hits int")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, of: int = 3, held: int = 1, most: tuple[int, int] = (8_000, 2_000), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, without those that score ``threshold`` or more.

    Each row is judged by its own text and passes through the scorer whole, so neither null nor repeated ids let one row
    decide on another. Null and empty texts have the base score and stay; an empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    judge = _scores(slim, labels, of, held, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_texts = judge()
        for batch in slices(batches, 1):
            yield batch.filter(pa.array([x[0] < threshold for x in of_texts(batch.column(1).to_pylist())], pa.bool_())).select([0])

    rows = docs.select(F.struct("*").alias(ROW), F.col(text_col).cast("string").alias("text"))
    kept = rows.mapInArrow(frugal(run), f"{ROW} {rows.schema[ROW].dataType.simpleString()}")
    return kept.select(f"{ROW}.*")
