"""Languages of documents and of stretches inside them, with confidences.

A bidirectional gated recurrent network over bytes reads whole texts, in long
windows with overlap: its states run on across words, and every position gets a
score for every language.  Scores are pooled to probabilities of words, a best path
over the words with a cost for every change of language gives the segments, and
the pooled probabilities of a segment's words, on a scale fitted to held-out
texts, its confidence.  Documents never leave their partition.

The network is trained in numpy on windows of clean reference samples, many of
which change the language at a word, then on windows of about ``SAMPLE_DOCS``
labelled documents (never over twice as many) of at most ``SAMPLE_BYTES`` each,
a share of all by the hash of their id, as far as the first network finds the
labelled language, and only it, in them.  A tenth of these is held out for the
scale.  Accents are also trained stripped, as text typed without them is common.
A trained network is stored under the digest of its sample and used again.

Defined results: null, empty and wordless texts have no language; words of no
letters take the language around them; a label that names a language in a code
or spelling of ``NAMES`` is that language, any other label is none.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.arrow import slices
from siltstone.llm.bigru import BiGRU
from siltstone.llm.leaks import _invisible
from siltstone.storage import shared_dir

LANGUAGES = ("vi", "en", "fr", "de", "es")
SAMPLE_DOCS, SAMPLE_BYTES = 1500, 20_000
STEPS, LENGTH, BATCH, CHANGE, FLOOR = (250, 350), 48, 128, 9.0, 0.04
MIN_RUN, MIN_WORDS = 10, 8
#: Names and codes of the languages in lower case.
NAMES = {
    "vi": ("vi", "vie", "vn", "vietnamese", "tiếng việt", "tieng viet", "viet", "việt", "vietnamien", "vietnamita", "vietnamesisch"),
    "en": ("en", "eng", "english", "anglais", "englisch", "inglés", "ingles", "tiếng anh"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch", "francés", "tiếng pháp"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "aleman", "tiếng đức"),
    "es": ("es", "spa", "esp", "spanish", "español", "espanol", "castellano", "espagnol", "spanisch", "tiếng tây ban nha"),
}


def label_code(label: str | None) -> str | None:
    """The language that a label names, with or without a region; None if none."""
    s = unicodedata.normalize("NFC", label or "").strip().lower()
    for code, names in NAMES.items():
        if s in names or s.replace("_", "-").split("-")[0].strip() in names or s.split("(")[0].strip() in names:
            return code
    return None


def plain(text: str) -> str:
    """A text's words in lower case NFC, one blank apart."""
    t = text.lower()
    if not t.isascii():
        t = _invisible.sub("", t)
        if not unicodedata.is_normalized("NFC", t):
            t = unicodedata.normalize("NFC", t)
    return " ".join(t.split())


def stripped(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.replace("đ", "d").replace("Đ", "D")) if not unicodedata.combining(c))


def batches_of(texts: list[tuple[str, str]], length: int = LENGTH, batch: int = BATCH):
    """A sampler of windows of ``length`` steps of two bytes and their labels: languages are drawn alike and often change at a word."""
    by: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
    bare: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)

    def ready(t: str) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer((t + " ").encode(), np.uint8)
        return x, np.concatenate([[0], np.flatnonzero(x[:-1] == 32) + 1])

    for lang, text in texts:
        if t := plain(text):
            by[LANGUAGES.index(lang)].append(ready(t))
            bare[LANGUAGES.index(lang)].append(ready(stripped(t)))
    known = sorted(by)
    weight = {k: np.cumsum([len(x) for x, _ in by[k]]) for k in known}

    def piece(r: np.random.Generator, k: int, most: int) -> np.ndarray:
        i = int(np.searchsorted(weight[k], r.integers(weight[k][-1]), "right"))
        x, words = (bare if r.random() < (0.3 if k == 0 else 0.1) else by)[k][i]
        first = int(words[r.integers(len(words))])
        if first + most >= len(x):
            return x[first:]
        to = int(words[np.searchsorted(words, first + most, "right") - 1])
        return x[first : to if to > first else first + most]

    def draw(r: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.empty((2 * length, batch), np.int64), np.empty((2 * length, batch), np.int64)
        for b in range(batch):
            k, at = known[r.integers(len(known))], 0
            mixed = r.random() < 0.5
            while at < 2 * length:
                got = piece(r, k, int(r.integers(15, 70)) if mixed else 2 * length)[: 2 * length - at]
                x[at : at + len(got), b], y[at : at + len(got), b] = got, k
                at += len(got)
                if mixed and r.random() < 0.6:
                    k = known[r.integers(len(known))]
        return x.reshape(length, 2, batch).transpose(0, 2, 1), y[::2]

    return draw


class Tagger:
    """Scores of words by a trained network, and segments of texts."""

    def __init__(self, net: BiGRU):
        self.net, self.lettered = net, {}

    def _lettered(self, token: bytes) -> bool:
        """Whether a token without plain Latin letters has a letter."""
        if token not in self.lettered:
            if len(self.lettered) > 100_000:
                self.lettered.clear()
            self.lettered[token] = any(c.isalpha() for c in token.decode())
        return self.lettered[token]

    def words(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Log probabilities of words, row 0 for those of no letters, and every text's rows."""
        data = [plain(t).encode("utf-8", "replace") for t in texts]
        data = [d + b"\n" * (2 - len(d) % 2) for d in data]  # every text starts at an even place
        sizes = np.array([len(d) for d in data], np.int64)
        starts = np.cumsum(sizes) - sizes
        sizes -= np.array([len(d) - len(d.rstrip(b"\n")) for d in data], np.int64)
        buf = np.frombuffer(b"".join(data), np.uint8)
        y = self.net.scores(buf, starts[sizes > 0], (starts + sizes)[sizes > 0])
        ends = np.flatnonzero((buf == 32) | (buf == 10))
        first = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
        real = ends > first
        first, ends = first[real], ends[real]
        if not len(first):
            return np.zeros((1, len(LANGUAGES)), np.float32), [np.zeros(0, np.int64) for _ in texts]
        # Words are one blank apart, so that the steps up to the next word's first one are a word's own.
        table = np.add.reduceat(y, first // 2, axis=0) / ((ends + 1) // 2 - first // 2)[:, None] + self.net.p["o"]
        table = np.exp(table - table.max(1, keepdims=True))
        table = np.log(table * ((1 - FLOOR) / table.sum(1, keepdims=True)) + FLOOR / len(LANGUAGES))
        latin = np.add.reduceat(((buf >= 97) & (buf <= 122)).astype(np.int32), first) > 0
        other = np.flatnonzero(~latin & (np.add.reduceat((buf >= 128).astype(np.int32), first) > 0))
        for i in other:
            latin[i] = self._lettered(buf[first[i] : ends[i]].tobytes())
        row = np.where(latin, np.arange(1, len(first) + 1), 0)
        table = np.concatenate([np.zeros((1, len(LANGUAGES)), np.float32), table.astype(np.float32)])
        edges = np.searchsorted(first, np.append(starts, len(buf)))
        return table, [row[edges[i] : edges[i + 1]] for i in range(len(texts))]

    def states(self, table: np.ndarray, tokens: list[np.ndarray]) -> list[np.ndarray]:
        """The best language of every token of texts of like length."""
        longest, k = max(map(len, tokens)), len(LANGUAGES)
        x = np.zeros((longest, len(tokens)), np.int64)
        for i, t in enumerate(tokens):
            x[: len(t), i] = t
        score = table[x[0]].copy()
        moved = np.zeros((longest, len(tokens), k), bool)
        best = np.zeros((longest, len(tokens)), np.int8)
        for t in range(1, longest):
            b = score.argmax(1)
            to = score[np.arange(len(tokens)), b][:, None] - CHANGE
            moved[t] = to > score
            best[t] = b
            score = np.maximum(score, to) + table[x[t]]
        state = np.zeros((longest, len(tokens)), np.int8)
        now = score.argmax(1)
        rows = np.arange(len(tokens))
        for t in range(longest - 1, -1, -1):
            state[t] = now
            now = np.where(moved[t][rows, now], best[t], now)
        return [state[: len(t), i] for i, t in enumerate(tokens)]

    def segments(self, texts: list[str | None]) -> list[list[tuple[int, int, int, float]]]:
        """``first word, words, language, confidence`` of every stretch of every text."""
        table, tokens = self.words([t or "" for t in texts])
        out: list[list] = [[] for _ in texts]
        order = sorted((i for i, t in enumerate(tokens) if t.any()), key=lambda i: len(tokens[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to - at + 1) * len(tokens[order[to]]) < 300_000:
                to += 1
            part = order[at:to]
            for i, s in zip(part, self.states(table, [tokens[i] for i in part]), strict=True):
                ends = np.append(np.flatnonzero(np.diff(s)) + 1, len(s))
                first = 0
                for e in ends:
                    ids = tokens[i][first:e]
                    pooled = table[ids[ids > 0]].sum(0, dtype=np.float64)
                    q = np.exp((pooled - pooled.max()) * self.net.scale)
                    out[i].append((int(first), int(e - first), int(s[first]), float(q[s[first]] / q.sum())))
                    first = e
            at = to
        return out


def calibrated(net: BiGRU, held_out: list[tuple[str, str]], words: int = 8) -> float:
    """The scale of pooled evidence under which stretches of few words of held-out texts are most probable."""
    table, tokens = Tagger(net).words([t for _, t in held_out])
    pooled, right = [], []
    for (lang, _), ids in zip(held_out, tokens, strict=True):
        ids = ids[ids > 0]
        for k in range(0, len(ids) - words + 1, words):
            pooled.append(table[ids[k : k + words]].sum(0, dtype=np.float64))
            right.append(LANGUAGES.index(lang))
    if not pooled:
        return net.scale
    x, i = np.array(pooled), np.arange(len(right))

    def loss(scale: float) -> float:
        y = x * scale
        return float((np.log(np.exp(y - y.max(1, keepdims=True)).sum(1)) + y.max(1) - y[i, right]).mean())

    return float(min(np.geomspace(0.02, 1.0, 18), key=loss))


def train(samples: list[tuple[str, str]], labelled: list[tuple[str, str]] = (), steps: tuple[int, int] = STEPS) -> BiGRU:
    """A network from clean ``(lang, text)`` samples and labelled texts that it confirms."""
    net = BiGRU(len(LANGUAGES))
    if not samples:
        return net
    net.fit(batches_of(samples), steps[0])
    held_out = []
    if labelled:
        found = Tagger(net).segments([t for _, t in labelled])
        sure = [(lang, t) for (lang, t), s in zip(labelled, found, strict=True) if len(s) == 1 and LANGUAGES[s[0][2]] == lang and s[0][1] >= 30]
        held_out, sure = sure[::10], [x for i, x in enumerate(sure) if i % 10]
        if sure:
            net.fit(batches_of([*samples, *sure]), steps[1], rate=0.01)
    net.scale = calibrated(net, held_out or samples)
    return net


_nets: dict[str, BiGRU] = {}


def stored_net(spark, samples: list[tuple[str, str]], labelled: list[tuple[str, str]]) -> BiGRU:
    """The network of this sample, trained once and kept in the shared folder under the sample's digest."""
    digest = hashlib.sha256(repr((samples, labelled, STEPS, LENGTH, BATCH, FLOOR)).encode("utf-8", "replace")).hexdigest()[:32]
    if digest not in _nets:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/language-{digest}.npz")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            data = bytes(spark.read.format("binaryFile").load(path.toString()).first()["content"])
        else:
            data = train(samples, labelled).dumps()
            out = fs.create(path, True)
            out.write(bytearray(data))
            out.close()
        _nets.clear()
        _nets[digest] = BiGRU.loads(data)
    return _nets[digest]


def trained(samples: DataFrame, docs: DataFrame, key: str, text: str, label: str, sample_docs: int = SAMPLE_DOCS) -> BiGRU:
    """Trains on the reference table (of fixed size) and the bounded sample of documents."""
    clean = [(r[0], r[1]) for r in samples.filter(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull()).orderBy("sample_id").select("lang", "text").limit(10_000).collect()]
    some = docs.filter(F.col(text).isNotNull() & (F.octet_length(text) <= SAMPLE_BYTES) & F.col(label).isNotNull() & F.col(key).isNotNull())
    # A share of the ids by their hash, so that no task sends more than its part of the sample.
    share = min(1.0, sample_docs / max(1, docs.count()))
    some = some.filter(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = sorted(some.select(F.col(key).cast("string").alias("k"), F.col(label).alias("l"), F.col(text).alias("t")).limit(2 * sample_docs).collect())
    return stored_net(docs.sparkSession, clean, [(c, r["t"]) for r in some if (c := label_code(r["l"]))])


def tag(docs: DataFrame, key: str, text: str, net: BiGRU) -> DataFrame:
    """``doc_key, n_words, segments`` with an array of ``first_word, n_words, lang_code, confidence``."""
    schema = docs.select(F.col(key).alias("doc_key")).schema.add("n_words", "integer").add("segments", _segments_type())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(net)
        kind = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang_code", pa.string()), ("confidence", pa.float64())]))
        for b in slices(batches, "text", 4 << 20):
            got = tagger.segments(b.column(1).to_pylist())
            rows = [[{"first_word": f, "n_words": n, "lang_code": LANGUAGES[s], "confidence": c} for f, n, s, c in g] for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sum(s[1] for s in g) for g in got], pa.int32()), pa.array(rows, kind)], ["doc_key", "n_words", "segments"])

    return docs.select(F.col(key).alias("doc_key"), F.col(text).alias("text")).mapInArrow(work, schema)


_taggers: dict[bytes, Tagger] = {}


def _tagger(net: BiGRU) -> Tagger:
    """One tagger a worker process and network, so that what it remembers lasts over tasks."""
    name = b"".join(net.p[k].tobytes() for k in ("O", "o", "zh", "ch"))
    if name not in _taggers:
        _taggers.clear()
        _taggers[name] = Tagger(net)
    return _taggers[name]


def _segments_type():
    from pyspark.sql import types as T

    fields = [("first_word", T.IntegerType()), ("n_words", T.IntegerType()), ("lang_code", T.StringType()), ("confidence", T.DoubleType())]
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields]))


def code_of(label: Column) -> Column:
    """``label_code`` as an expression; null if the label names no language."""
    s = F.lower(F.trim(label))
    head = F.trim(F.split(F.regexp_replace(s, "[(_].*$", "-"), "-")[0])
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        spelled = [f(n) for n in names for f in (lambda x: unicodedata.normalize("NFC", x), lambda x: unicodedata.normalize("NFD", x))]
        out = F.when(s.isin(*spelled) | head.isin(*spelled), F.lit(code)).otherwise(out)
    return out


def held(tagged: DataFrame, min_run: int = MIN_RUN) -> Column:
    """The distinct languages with a run of at least ``min_run`` words; the main one if there is none."""
    runs = F.filter("segments", lambda s: s["n_words"] >= min_run)
    longest = F.array_max(F.transform("segments", lambda s: F.struct(s["n_words"].alias("n"), (-s["first_word"]).alias("f"), s["lang_code"].alias("lang_code"))))["lang_code"]
    only = F.when(F.size("segments") > 0, F.array(longest)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(runs) > 0, F.array_distinct(F.transform(runs, lambda s: s["lang_code"]))).otherwise(only)

