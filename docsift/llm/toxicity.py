"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

Telling strings are the strings of SIZES characters, word ends included, that toxic documents have far more often than
ordinary ones. A window is the words in order around a word that holds one, NEAR to either side. It is compressed with the ordinary dictionary
and with the toxic one, which is made of toxic windows before the same ordinary text, so that lengths differ only by what
toxic text adds. A window's distance is its length with the ordinary dictionary less that with the toxic one. Besides, the whole text is cut into runs of RUN
words, and every run is compressed in the same way, so that text without a telling string counts, too. A document's score is a
logistic function, fitted to labelled rows, of its largest distances, of how many distinct windows reach each of several
thresholds, of its length, and of its runs' largest and mean distance and of how many of them reach each of RUN_THRESHOLDS.

Learning is bounded, by documented parameters: SAMPLE labelled rows of each class, those of smallest hash; of each of them at most
WINDOWS windows, evenly spread, train a dictionary. Two thirds of the rows give telling strings and dictionaries; how common and how
one-sided a telling string must be is chosen by the loss on the others; then all rows give them. Strings are counted in tasks; what reaches the
driver is the strings that pass, those windows, and one row of features for each labelled row. All documents are scored in full.

Null texts count as empty; an empty text scores as a document without toxic windows. Labels that are null are no labels;
an id labelled twice is toxic if either label is. Without labels of both classes every score is 0. Repeated rows are kept.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import as_bytes, slices, tidied, written

SAMPLE, WINDOWS = 3000, 24
SIZES, NEAR = (5, 6, 8), 1
#: (the least share of toxic documents that have a telling string, the least log odds)
CHOICES = ((0.1, 1.5), (0.05, 1.5), (0.03, 2.0), (0.015, 2.5))
LEAST_ROWS = 3
TOP, THRESHOLDS = 5, (1, 2, 3, 4, 6)
RUN, RUN_THRESHOLDS = 24, (2, 4)
TOXIC_BYTES, ORDINARY_BYTES = 2048, 16_384
KEPT = 50_000
HELD_OUT = 2
#: 0-9, a-z and bytes from 0x80 on; A-Z become a-z, all else parts words.
TO_WORDS = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def is_held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def split(texts: list[bytes | None]) -> pa.ListArray:
    """The words of each text."""
    return pc.ascii_split_whitespace(pa.array([(t or b"").translate(TO_WORDS).strip() for t in texts], pa.binary()).cast(pa.string()))


def strings(word: str) -> list[str]:
    text = f" {word} "
    return [text[i : i + n] for n in SIZES for i in range(len(text) - n + 1)]


def window(words: pa.Array, i: int, first: int, end: int) -> bytes:
    """The words around words[i], of those from first to end."""
    return f" {' '.join(words[max(i - NEAR, first) : min(i + NEAR + 1, end)].to_pylist())} ".encode()


def telling_windows(texts: list[bytes | None], telling: list[str]) -> list[list[bytes]]:
    """Of each text the windows around words with a telling string, in order."""
    found = split(texts)
    out: list[list[bytes]] = [[] for _ in texts]
    if not telling:
        return out
    words = found.flatten()
    coded = words.dictionary_encode()
    tells = pc.match_substring_regex(pc.binary_join_element_wise("", coded.dictionary, "", " "), "|".join(sorted(telling)))
    at = np.flatnonzero(tells.to_numpy(zero_copy_only=False)[coded.indices.to_numpy()])
    ends = np.cumsum(pc.list_value_length(found).to_numpy())
    of = np.searchsorted(ends, at, "right")
    for i, d in zip(at.tolist(), of.tolist(), strict=True):
        out[d].append(window(words, i, int(ends[d - 1]) if d else 0, int(ends[d])))
    return out


def runs(text: bytes | None) -> list[bytes]:
    """All words of a text in order, RUN of them at a time."""
    words = (text or b"").translate(TO_WORDS).split()
    return [b" %b " % b" ".join(words[i : i + RUN]) for i in range(0, len(words), RUN)]


def spread(items: list, most: int = WINDOWS) -> list:
    return [items[i * len(items) // most] for i in range(most)] if len(items) > most else items


class Model:
    """The telling strings, the two dictionaries and the fitted function. Distances of recent windows are kept."""

    def __init__(self, telling: list[str], toxic: bytes, ordinary: bytes):
        self.content = telling, toxic, ordinary
        self.weights = np.zeros(TOP + len(THRESHOLDS) + 2 + 2 + len(RUN_THRESHOLDS))
        self.ready = False

    def __getstate__(self):
        return self.content, self.weights

    def __setstate__(self, state):
        self.content, self.weights = state
        self.ready = False

    def start(self) -> None:
        import zstandard as z

        self.telling, toxic, ordinary = self.content
        parameters = z.ZstdCompressionParameters.from_level(3, min_match=4, write_checksum=0, write_content_size=0, write_dict_id=0)
        compressor = lambda content: z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=parameters).compress
        self.toxic, self.ordinary = compressor(toxic + ordinary), compressor(ordinary)
        self.known: dict[bytes, int] = {}
        self.ready = True

    def distance(self, window: bytes) -> int:
        if (d := self.known.get(window)) is None:
            if len(self.known) > KEPT:
                self.known.clear()
            d = len(self.ordinary(window)) - len(self.toxic(window))
            if len(window) < 200:
                self.known[window] = d
        return d

    def features(self, texts: list[bytes | None]) -> np.ndarray:
        """A row for each text: its TOP largest distances, from 0 to 10; the log of how many distinct windows reach each threshold; of its bytes; 1."""
        if not self.ready:
            self.start()
        out = []
        for text, found in zip(texts, telling_windows(texts, self.telling), strict=True):
            at = sorted(map(self.distance, set(found)), reverse=True)
            top = [min(max(d, 0), 10) for d in at[:TOP]]
            out.append([*top, *(0,) * (TOP - len(top)), *(np.log1p(sum(d >= t for d in at)) for t in THRESHOLDS), np.log1p(len(text or b"")) / 10, 1.0])
        return np.array(out, float).reshape(-1, TOP + len(THRESHOLDS) + 2)

    def whole(self, texts: list[bytes | None]) -> np.ndarray:
        """A row for each text: of all its runs the largest distance, from 0 to 10, the mean one, and the log of how many reach each threshold; then its features, whose last is 1."""
        of_windows = self.features(texts)
        out = []
        for text in texts:
            at = [self.distance(r) for r in runs(text)] or [0]
            out.append([min(max(*at, 0), 10), sum(at) / len(at), *(np.log1p(sum(d >= t for d in at)) for t in RUN_THRESHOLDS)])
        return np.concatenate([np.array(out, float).reshape(-1, 2 + len(RUN_THRESHOLDS)), of_windows], 1)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> None:
        """Logistic regression by Newton steps."""
        w = np.zeros(x.shape[1])
        penalty = np.full(x.shape[1], ridge)
        penalty[-1] = 1e-3
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w



def dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a trained dictionary; of too few samples, the samples."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except z.ZstdError:
        return b" ".join(dict.fromkeys(samples))[-size:]


def one_sided(counts: list[tuple[str, int, int]], n: tuple[int, int], share: float, odds: float) -> list[str]:
    """Of strings with how many ordinary and toxic documents have them (of n), those that tell."""
    least = max(min(LEAST_ROWS, n[1]), share * n[1])
    return sorted(s for s, c0, c1 in counts if c1 >= least and np.log((c1 + 0.5) / (n[1] + 1)) - np.log((c0 + 0.5) / (n[0] + 1)) >= odds)


def labelled(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str) -> DataFrame:
    """A written table (doc_id, toxic, text, learn): at most sample labelled documents of each class, without those held out."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(~is_held_out("doc_id")).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    chosen = {r["doc_id"]: r["toxic"] for own in chosen for r in own.collect()}  # at most 2 x sample rows
    ids = docs.sparkSession.createDataFrame(list(chosen.items()) or [(None, 0)], "doc_id long, toxic int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))  # an id may stand on several rows
    return written(rows.withColumn("learn", F.pmod(F.xxhash64(F.lit("learn"), F.col("doc_id")), F.lit(3)) > 0), "toxicity-sample")


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model from at most sample labelled documents of each class, without those held out."""
    rows = labelled(docs, labels, sample, id_col, text_col)
    sizes = {(r["toxic"], r["learn"]): r["count"] for r in rows.groupBy("toxic", "learn").count().collect()}
    n = tuple(sizes.get((c, True), 0) for c in (0, 1))
    if not all(n):  # too few to set any aside
        rows = rows.withColumn("learn", F.lit(True))
        n = tuple(sizes.get((c, True), 0) + sizes.get((c, False), 0) for c in (0, 1))
        if not all(n):
            return None
    rows = rows.select("doc_id", "toxic", "text", "learn")
    every = tuple(sum(v for (c, _), v in sizes.items() if c == k) for k in (0, 1))

    @tidied
    def count(batches):
        for batch in batches:
            for part in slices(batch, 2, 1 << 20):
                found = {(c, own): Counter() for own in (True, False) for c in (0, 1)}
                for c, own, words in zip(part.column(1).to_pylist(), part.column(3).to_pylist(), split(as_bytes(part.column(2))).to_pylist(), strict=True):
                    found[c, own].update({s for w in set(words) for s in strings(w)})
                keys = list(set().union(*found.values()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([x[s] for s in keys], pa.int64()) for x in found.values())], ["s", "l0", "l1", "a0", "a1"])

    least = max(min(LEAST_ROWS, n[1]), min(share for share, _ in CHOICES) * n[1])
    counts = rows.mapInArrow(count, "s string, l0 long, l1 long, a0 long, a1 long").groupBy("s").agg(F.sum("l0").alias("l0"), F.sum("l1").alias("l1"), F.sum(F.col("l0") + F.col("a0")).alias("c0"), F.sum(F.col("l1") + F.col("a1")).alias("c1"))
    counts = counts.where(F.col("c1") >= least).where((F.col("c1") + 0.5) / (every[1] + 1) > (F.col("c0") + 0.5) / (every[0] + 1)).collect()  # at most a toxic document's strings, over the least share
    telling = [one_sided([(s, l0, l1) for s, l0, l1, _, _ in counts], n, *choice) for choice in CHOICES]
    toxic, ordinary = dictionaries(rows.where("learn"), telling)
    models = {k: Model(t, d, ordinary) for k, (t, d) in enumerate(zip(telling, toxic, strict=True)) if t and d}
    if not models:
        return Model([], b"", ordinary)
    shared = docs.sparkSession.sparkContext.broadcast(list(models.values()))

    @tidied
    def measure(batches):
        for batch in batches:
            for part in slices(batch, 2, 4 << 20):
                x = np.concatenate([m.whole(as_bytes(part.column(2))) for m in shared.value], 1)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in (0, 1, 3)), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "toxic", "learn", "x"])

    measured = sorted(rows.mapInArrow(measure, "doc_id long, toxic int, learn boolean, x array<double>").collect())
    y, aside = np.array([float(r["toxic"]) for r in measured]), np.array([not r["learn"] for r in measured])
    aside = aside if aside.any() else ~aside
    losses = {}
    for (k, m), x in zip(models.items(), np.split(np.array([r["x"] for r in measured]), len(models), 1), strict=True):
        m.fit(x[aside], y[aside])
        p = np.clip(m.score(x[aside]), 1e-6, 1 - 1e-6)
        losses[k] = -np.mean(y[aside] * np.log(p) + (1 - y[aside]) * np.log(1 - p))
        m.fit(x, y)
    best = min(losses, key=losses.get)
    # the strings and dictionaries that score are those of all rows, by the choice and the function that were found
    telling = one_sided([(s, c0, c1) for s, _, _, c0, c1 in counts], every, *CHOICES[best])
    (toxic,), ordinary = dictionaries(rows, [telling])
    out = Model(telling, toxic, ordinary)
    out.weights = models[best].weights
    return out


def dictionaries(rows: DataFrame, telling: list[list[str]]) -> tuple[list[bytes], bytes]:
    """A toxic dictionary for each list of telling strings, and the ordinary one, from at most WINDOWS windows of each row (doc_id, toxic, text)."""

    @tidied
    def cut(batches):
        for batch in batches:
            for part in slices(batch, 2, 4 << 20):
                texts, ids, toxic = as_bytes(part.column(2)), part.column(0).to_pylist(), part.column(1).to_pylist()
                out = []
                for d, c, words in zip(ids, toxic, split(texts), strict=True):
                    if not c:
                        own = words.values
                        out.append((0, d, b"\n".join(window(own, i, 0, len(own)) for i in spread(list(range(NEAR, max(len(own), NEAR + 1), 2 * NEAR + 1))) if len(own))))
                for k, own in enumerate(telling, 1):
                    out += [(k, d, b"\n".join(spread(w))) for d, c, w in zip(ids, toxic, telling_windows(texts, own), strict=True) if c and w]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["k", "doc_id", "windows"])

    found: list[list[bytes]] = [[] for _ in range(len(telling) + 1)]
    for r in sorted(rows.mapInArrow(cut, "k int, doc_id long, windows binary").collect()):  # at most WINDOWS windows of each row and list
        found[r["k"]] += [w for w in bytes(r["windows"]).split(b"\n") if w]
    return [dictionary(w, TOXIC_BYTES, 20) for w in found[1:]], dictionary(found[0], ORDINARY_BYTES, 50)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, and the text and the column carry, as carried, if one is named. One pass over the texts, no shuffle; the model is about 20 KB."""
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, sample, id_col, text_col))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"), *([F.col(carry).alias("carried")] if carry else []))
    more = f", text string, carried {source.schema['carried'].dataType.simpleString()}" if carry else ""

    @tidied
    def run(batches):
        m = model.value
        for batch in batches:
            for part in slices(batch, 2, 4 << 20):
                texts = as_bytes(part.column(2))
                scores = m.score(m.whole(texts)) if m else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32)), *(part.columns[2:] if carry else [])], ["doc_id", "held_out", "score", "predicted", *(part.schema.names[2:] if carry else [])])

    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int" + more)
