"""Missing or wrong language labels: segmentation-marginalised unigrams over a fixed public vocabulary."""

from __future__ import annotations

import base64
import importlib.util
import os
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stanzaflow.llm.tables import sung_text
from stanzaflow.operators.skew import once

#: Labelled lines to fit on: at most so many per language.
SAMPLES_PER_LANGUAGE = 2_000
ROUNDS, BACKGROUND = 4, 30.0
#: Words of up to so many bytes are summed side by side, so many at a time; a longer one by itself, with the same result.
SIDE_BY_SIDE, BLOCK = 64, 20_000
#: Nats by which a section must fit another language better before it counts as that language, and words it needs.
MARGIN, LEAST_WORDS = 6.0, 3
#: Keeps the forward sums of long words near one; it cancels out.
SCALE = 8.0
#: ISO 639-1 codes with the three-letter codes and names they go by.
LABELS = {
    "en": "eng english", "es": "spa spanish español castellano", "de": "deu ger german deutsch", "fr": "fra fre french français", "pt": "por portuguese português", "nl": "nld dut dutch nederlands",
    "ru": "rus russian русский", "it": "ita italian italiano", "pl": "pol polish polski", "sv": "swe swedish svenska", "ko": "kor korean 한국어", "he": "heb iw hebrew עברית",
}


def vocabulary(path: str | None = None) -> list[bytes]:
    """The pieces of a public byte-level vocabulary (tiktoken ranks), and all single bytes."""
    if path is None:
        spec = importlib.util.find_spec("public_tokenizers")
        path = os.path.join(os.path.dirname(spec.origin) if spec else "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    known = set(pieces)
    return pieces + [bytes([b]) for b in range(256) if bytes([b]) not in known]


def byte_words(words: list[str]) -> list[bytes]:
    """Words as the vocabulary writes them, with the space before."""
    return [b" " + w.encode() for w in words]


@dataclass
class Model:
    """ids: piece to row; logs of nothing: probs[row, language] are probabilities times SCALE per byte."""

    ids: dict[bytes, int]
    probs: np.ndarray
    langs: list[str]

    @property
    def longest(self) -> int:
        """Bytes of the longest piece."""
        return max(map(len, self.ids))

    def score(self, words: list[str]) -> np.ndarray:
        """log P(word | language), summed over all segmentations of each whole word into pieces; words of like length together."""
        out = np.zeros((len(words), len(self.langs)))
        by_size: dict[int, list[tuple[int, bytes]]] = {}
        for i, w in enumerate(byte_words(words)):
            by_size.setdefault(len(w), []).append((i, w))
        none, longest = len(self.probs) - 1, self.longest
        get = self.ids.get
        for n, every in by_size.items():
            if n > SIDE_BY_SIDE:
                for i, w in every:
                    out[i] = self._long(w, longest)
                continue
            for at in range(0, len(every), BLOCK):
                group = every[at : at + BLOCK]
                table = np.array([[get(w[i:j], none) for j in range(1, n + 1) for i in range(max(0, j - longest), j)] for _, w in group])
                alpha = np.zeros((n + 1, len(group), len(self.langs)))
                alpha[0] = 1.0
                col = 0
                for j in range(1, n + 1):
                    for i in range(max(0, j - longest), j):
                        alpha[j] += alpha[i] * self.probs[table[:, col]]
                        col += 1
                out[[i for i, _ in group]] = np.log(np.maximum(alpha[n], 1e-300)) - n * np.log(SCALE)
        return out

    def _long(self, word: bytes, longest: int) -> np.ndarray:
        """The forward sum of one word of any length, in memory of the longest piece: sums are brought back to one as it goes."""
        sums, logs = [np.ones(len(self.langs))], np.zeros(len(self.langs))
        for j in range(1, len(word) + 1):
            total = np.zeros(len(self.langs))
            for back in range(1, len(sums) + 1):
                if (k := self.ids.get(word[j - back : j])) is not None:
                    total = total + sums[-back] * self.probs[k]
            sums = [*sums[-(longest - 1) :], total] if longest > 1 else [total]
            if j % 16 == 0:
                top = np.maximum(np.max(sums, axis=0), 1e-300)
                sums = [x / top for x in sums]
                logs = logs + np.log(top)
        return np.log(np.maximum(sums[-1], 1e-300)) + logs - len(word) * np.log(SCALE)


def _expected(word: bytes, ids: dict[bytes, int], p: np.ndarray, times: int, into: np.ndarray, longest: int) -> None:
    """Add the expected piece counts of a whole word under p, scaled by SCALE a byte, over all its segmentations."""
    n = len(word)
    f = np.zeros(n + 1)
    b = np.zeros(n + 1)
    f[0] = b[n] = 1.0
    edges = [(i, j, k) for j in range(1, n + 1) for i in range(max(0, j - longest), j) if (k := ids.get(word[i:j])) is not None]
    for i, j, k in edges:
        f[j] += f[i] * p[k]
    for i, j, k in reversed(edges):
        b[i] += p[k] * b[j]
    if f[n] > 0:
        for i, j, k in edges:
            into[k] += times * f[i] * p[k] * b[j] / f[n]


def fit(samples: list[tuple[str, str]], pieces: list[bytes]) -> Model:
    """Piece probabilities of every language by expectation-maximisation over all segmentations of its lines."""
    langs = sorted({lang for lang, _ in samples})
    counts = {lang: Counter(byte_words([w for la, t in samples if la == lang for w in words_of(t)])) for lang in langs}
    longest = max(map(len, pieces))
    texts = {w[i:j] for c in counts.values() for w in c for i in range(len(w)) for j in range(i + 1, min(len(w), i + longest) + 1)}
    known = [p for p in pieces if p in texts or len(p) == 1]
    ids = {p: i for i, p in enumerate(known)}
    size = np.array([len(p) for p in known], float)
    flat = np.exp(-3.0 * size)
    flat /= flat.sum()
    probs = {lang: flat.copy() for lang in langs}
    for _ in range(ROUNDS):
        found = {}
        for lang in langs:
            into = np.zeros(len(known))
            for w, k in counts[lang].items():
                _expected(w, ids, probs[lang] * SCALE**size, k, into, longest)
            found[lang] = into
        shared = sum(x / max(1e-9, x.sum()) for x in found.values()) / len(langs)
        for lang in langs:
            p = found[lang] + BACKGROUND * (0.3 * shared + 0.7 * flat)
            probs[lang] = p / p.sum()
    # a piece that no sample holds has one small probability in all languages; the last row is for what is no piece
    rest = [p for p in pieces if p not in ids]
    table = np.zeros((len(known) + len(rest) + 1, len(langs)))
    for k, lang in enumerate(langs):
        table[: len(known), k] = probs[lang] * SCALE**size
    for i, p in enumerate(rest):
        ids[p] = len(known) + i
        table[len(known) + i] = 1e-8 * SCALE ** len(p) * np.exp(-len(p))
    return Model(ids, table, langs)


def words_of(text: str) -> list[str]:
    """Lower-case words of a sample line, as ``section_words`` makes them."""
    text = "".join(c if c.isalpha() or c in "'’" or 0x300 <= ord(c) < 0x370 else " " for c in text.lower())
    return text.replace("’", "'").split()


def section_words(text: Column) -> Column:
    """Lower-case words of a section, single spaces between them."""
    t = F.replace(F.lower(text), F.lit("’"), F.lit("'"))
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{M}']+", " "))


def with_sections(documents: DataFrame) -> DataFrame:
    """Adds ``sections``, the sections of a document as words, and ``heading``, whether the first of them is its title.

    Sections are separated by blank lines, in prose by line ends. The first is the title if it equals ``title``, or where
    that is missing if it is a single line of at most ten words before others. Section names, chords and directives are
    gone; a section without words is none.
    """
    body = once(documents, "_body", F.regexp_replace(sung_text(F.col("text")), r"^\s+", ""))
    blank = F.col("_body").rlike(r"\S[ \t]*\n[ \t]*\n\s*\S")
    raw = F.split(F.col("_body"), F.when(blank, F.lit(r"\n[ \t]*\n\s*")).otherwise(F.lit("\n")))
    worded = F.transform(raw, lambda x: F.struct(section_words(x).alias("w"), F.contains(F.trim(x), F.lit("\n")).alias("long")))
    parts = once(once(body, "_parts", F.filter(worded, lambda x: x["w"] != "")), "_named", section_words(F.coalesce("title", F.lit(""))))
    first, several, named = F.try_element_at("_parts", F.lit(1)), F.size("_parts") > 1, F.col("_named")
    guess = (named == "") & ~first["long"] & several & (F.size(F.split(first["w"], " ")) <= 10)
    heading = F.coalesce((F.size("_parts") > 0) & ((first["w"] == named) | guess), F.lit(False))
    return parts.withColumn("heading", heading).withColumn("sections", F.transform("_parts", lambda x: x["w"])).drop("_body", "_parts", "_named")


def normal_label(label: Column) -> Column:
    """ISO 639-1 code of a label in any style: case, region, three letters, name. Null for what names no language here."""
    codes = {name: code for code, names in LABELS.items() for name in [code, *names.split()]}
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.try_element_at(table, F.split(F.lower(F.trim(F.coalesce(label, F.lit("")))), "[-_. ]")[0])


RESULT = "doc_id bigint, label string, lang string, confidence double, segments array<struct<first:int,sections:int,words:int,heading:boolean,lang:string,confidence:double>>"


def _posterior(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def labelled(documents: DataFrame, lang_samples: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Of every document its language with a confidence, and its segments in order with theirs.

    A segment is a run of sections of one language; words are scored with every language's piece probabilities, summed
    over all segmentations, and a section leaves the document's main language only if another fits it better by MARGIN
    nats. A title is a segment of its own, marked as ``heading``, and has no say in the main language unless there is
    nothing else. Confidence is the posterior under equal priors. A document without words (null, empty, only chords)
    has null language and no segments. Whole texts are read.
    """
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("lang").orderBy("sample_id"))
    rows = lang_samples.where("text <> '' and lang <> ''").withColumn("_k", rank).where(F.col("_k") <= SAMPLES_PER_LANGUAGE).select("lang", "text").collect()
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(cloudpickle.dumps(fit(sorted((r["lang"], r["text"]) for r in rows), vocabulary(vocabulary_path))))
    kind = pa.list_(pa.struct([("first", pa.int32()), ("sections", pa.int32()), ("words", pa.int32()), ("heading", pa.bool_()), ("lang", pa.string()), ("confidence", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(model.value)
        known: dict[str, int] = {}
        table = np.zeros((1024, len(m.langs)), np.float32)
        for batch in batches:
            lists = batch.column(1)
            off = lists.offsets.to_numpy().astype(np.int64)
            texts = lists.values.slice(off[0], off[-1] - off[0])
            off = off - off[0]
            heads = batch.column(3).to_pylist()
            langs: list = [None] * batch.num_rows
            sure: list = [None] * batch.num_rows
            segments: list = [[] for _ in range(batch.num_rows)]
            if len(texts):
                words = pc.split_pattern(texts, " ")
                each = words.values.dictionary_encode() if not isinstance(words, pa.ChunkedArray) else words.combine_chunks().values.dictionary_encode()
                names = each.dictionary.to_pylist()
                if len(known) > 500_000:  # the memory of a task stays bounded; forgotten words are scored again
                    known.clear()
                new = [w for w in names if w not in known]
                if new:
                    scores = m.score(new)
                    base = len(known)
                    while base + len(new) > len(table):
                        table = np.concatenate([table, np.zeros_like(table)])
                    table[base : base + len(new)] = scores
                    known.update((w, base + i) for i, w in enumerate(new))
                index = np.array([known[w] for w in names], np.int64)[each.indices.to_numpy()]
                starts = words.offsets.to_numpy().astype(np.int64)
                size = np.diff(starts)
                sec = np.add.reduceat(table[index].astype(np.float64), starts[:-1] - starts[0], axis=0)
                best = sec.argmax(axis=1)
                top2 = np.partition(sec, -2, axis=1)[:, -2]
                clear = (sec[np.arange(len(sec)), best] - top2 > MARGIN) & (size >= LEAST_WORDS)
                for d in np.flatnonzero(np.diff(off)):
                    a, b = off[d], off[d + 1]
                    head = int(heads[d])
                    x0 = a + head if b - a > head else a  # what counts for the main language
                    own = sec[a:b]
                    votes = np.bincount(best[x0:b][clear[x0:b]], size[x0:b][clear[x0:b]], len(m.langs))
                    main = int(votes.argmax()) if votes.any() else int(sec[x0:b].sum(axis=0).argmax())
                    gain = own.max(axis=1) - own[:, main]
                    lang = np.where((gain > MARGIN) & (size[a:b] >= LEAST_WORDS), best[a:b], main)
                    ends = set((np.flatnonzero(np.diff(lang)) + 1).tolist()) | ({1} if head else set())
                    cut = [0, *sorted(ends - {b - a}), b - a]
                    for x, y in zip(cut, cut[1:], strict=False):
                        post = _posterior(own[x:y].sum(axis=0, keepdims=True))[0, lang[x]]
                        segments[d].append({"first": x, "sections": y - x, "words": int(size[a + x : a + y].sum()), "heading": bool(head and x == 0), "lang": m.langs[lang[x]], "confidence": float(post)})
                    langs[d] = m.langs[main]
                    mine = sec[x0:b][lang[x0 - a :] == main]
                    sure[d] = float(_posterior(mine.sum(axis=0, keepdims=True))[0, main]) if len(mine) else 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(segments, kind)], names=["doc_id", "label", "lang", "confidence", "segments"])

    return with_sections(documents.select("doc_id", "text", "title", "lang")).select("doc_id", "sections", normal_label(F.col("lang")).alias("label"), "heading").mapInArrow(scan, RESULT)


def document_languages(documents: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence) of every document."""
    return labelled(documents, lang_samples).select("doc_id", "lang", F.round("confidence", 6).alias("confidence"))


def document_segments(documents: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """(doc_id, segment, first_section, sections, words, heading, lang, confidence) of every segment of every document."""
    rows = labelled(documents, lang_samples).select("doc_id", F.posexplode("segments").alias("segment", "s"))
    return rows.select("doc_id", "segment", F.col("s.first").alias("first_section"), "s.sections", "s.words", "s.heading", "s.lang", F.round("s.confidence", 6).alias("confidence"))


def label_cases(documents: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """(doc_id, true_lang): documents with words whose label is missing, no language or wrong, or that mix languages.

    One row per language of the sections; a title is none. The label travels through the scan beside the text, so nothing
    is joined.
    """
    sung = F.filter("segments", lambda s: ~s["heading"])
    rows = labelled(documents, lang_samples).where("doc_id is not null").select("doc_id", "label", F.array_distinct(F.transform(sung, lambda s: s["lang"])).alias("langs"))
    wrong = (F.size("langs") > 1) | F.col("label").isNull() | (F.col("label") != F.col("langs")[0])
    return rows.where(F.size("langs") > 0).where(wrong).select("doc_id", F.explode("langs").alias("true_lang")).distinct()
