"""Garbled text from wrong character encodings: a hidden Markov model with one clean state and one per encoding pair."""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

#: Fixed values: (true encoding, wrong decoding, what happened to the text afterwards).
PAIRS = [
    ("utf-8", "cp1252", ""),
    ("utf-8", "latin-1", ""),
    ("utf-8", "cp1252", "twice"),
    ("utf-8", "cp1252", "lower"),
    ("utf-8", "latin-1", "lower"),
    ("utf-8", "cp437", ""),
    ("utf-8", "cp850", ""),
    ("utf-8", "mac_roman", ""),
    ("utf-8", "cp1251", ""),
    ("utf-8", "cp1250", ""),
    ("utf-8", "cp852", ""),
    ("utf-8", "koi8-r", ""),
    ("cp1251", "cp1252", ""),
    ("cp1251", "koi8-r", ""),
    ("koi8-r", "cp1251", ""),
    ("koi8-r", "cp1252", ""),
    ("cp866", "cp1251", ""),
    ("cp866", "cp1252", ""),
    ("cp1255", "cp1252", ""),
    ("cp949", "cp1252", ""),
    ("cp1250", "cp1252", ""),
    ("iso8859-2", "cp1252", ""),
    ("cp852", "cp1250", ""),
    ("cp437", "cp1252", ""),
    ("cp850", "cp1252", ""),
    ("cp437", "latin-1", ""),
    ("cp850", "latin-1", ""),
    ("mac_roman", "cp1252", ""),
    ("mac_roman", "latin-1", ""),
    ("cp1252", "utf-16-le", ""),
    ("cp1252", "utf-8", ""),
    ("cp852", "cp1252", ""),
    ("cp1252", "cp437", ""),
    ("cp1252", "cp850", ""),
    ("cp1252", "mac_roman", ""),
    ("cp1252", "cp1250", ""),
]
#: Pairs whose images are mostly ordinary letters, so that other damage is easily taken for them: they take more evidence.
RARE = PAIRS[-5:]
#: Cost of entering and of leaving a garbled state, and of each plain character inside one, in nats. A state whose
#: true encoding is of another script garbles whole words, so it takes more evidence to enter.
ENTER, LEAVE, STAY = 5.0, 1.5, 0.03
OTHER_SCRIPT, ENTER_OTHER = ("cp1251", "koi8-r", "cp866", "cp1255", "cp949"), 16.0
#: The labelled lines that the model is fitted on: at most so many per language.
SAMPLES_PER_LANGUAGE = 2_000


def decoding_table(encoding: str) -> list[str]:
    """The 256 characters of a single-byte encoding; undefined bytes become the control characters of their number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


_TABLES = {d: decoding_table(d) for d in ("cp1252", "latin-1", "cp437", "cp850", "cp852", "mac_roman", "cp1251", "cp1250", "koi8-r")}
_BACK = {d: {c: b for b, c in enumerate(t)} for d, t in _TABLES.items()}


_MIXED = re.compile(r"[A-Za-z][\u0370-\u05ff\uac00-\ud7a3]|[\u0370-\u05ff\uac00-\ud7a3][A-Za-z]")


def misread(text: str, pair: tuple[str, str, str]) -> str | None:
    """What ``text`` looks like after the wrong decoding; None if its encoding has no such characters."""
    true, wrong, after = pair
    for _ in range(2 if after == "twice" else 1):
        try:
            raw = text.encode(true)
        except UnicodeEncodeError:
            return None
        if wrong == "utf-8":
            text = raw.decode("utf-8", "replace")
        elif wrong.startswith("utf-16"):
            text = raw[: len(raw) // 2 * 2].decode(wrong, "replace")
        else:
            table = _TABLES[wrong]
            text = "".join([table[b] for b in raw])
    return text.lower() if after == "lower" else text


def _raised(raw: bytes) -> bytes:
    """Lead bytes that lower case moved, moved back: a lead of a two-byte sequence lies 32 lower than its small letter."""
    out = bytearray(raw)
    for i, b in enumerate(raw):
        if 0xE0 <= b <= 0xFE and i + 1 < len(raw) and 0x80 <= raw[i + 1] < 0xC0 and not (i + 2 < len(raw) and 0x80 <= raw[i + 2] < 0xC0):
            out[i] = b - 32
    return bytes(out)


def _sequences(raw: bytes) -> tuple[str, int]:
    """Bytes with every valid multi-byte sequence of UTF-8 decoded and all others kept by number; how many there were."""
    out, i, found = [], 0, 0
    while i < len(raw):
        n = 1 if raw[i] < 0xC2 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4 if raw[i] < 0xF5 else 1
        try:
            c = raw[i : i + n].decode("utf-8")
            found += n > 1
        except UnicodeDecodeError:
            n, c = 1, ""
        out.append(c or f"\0{raw[i]:03d}")
        i += n
    return "".join(out), found


def restored(span: str, pair: tuple[str, str, str]) -> tuple[str, bool, int]:
    """The inverse of ``misread``: the text, whether all of it could be restored, and how many garbled sequences it had.

    What cannot be restored stays as it is.
    """
    true, wrong, after = pair
    if wrong == "utf-8":
        return span, False, span.count("�")
    if wrong.startswith("utf-16"):
        raw = span.encode(wrong, "surrogatepass").rstrip(b"\0")
        for encoding in ("utf-8", true):
            try:
                return raw.decode(encoding), True, len(span)
            except UnicodeDecodeError:
                pass
        return span, False, len(span)
    back, table, found, whole = _BACK[wrong], _TABLES[wrong], 0, True
    for _ in range(2 if after == "twice" else 1):
        out = []
        for known, run in groupby(span, key=back.__contains__):
            part = "".join(run)
            if known:
                raw = bytes([back[c] for c in part])
                if true == "utf-8":
                    part, n = _sequences(_raised(raw) if after == "lower" else raw)
                    whole &= "\0" not in part
                    part = re.sub(r"\0(\d{3})", lambda m: table[int(m[1])], part)
                else:
                    n = sum(b > 0x7F for b in raw)
                    try:
                        part = raw.decode(true)
                    except UnicodeDecodeError:
                        whole = False
                        part = "".join(_decoded(raw[i : i + 1], true) or part[i] for i in range(len(raw)))
                found += n
            else:
                whole &= part.isascii()
            out.append(part)
        span = "".join(out)
    return span, whole, found


def _decoded(raw: bytes, encoding: str) -> str:
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return ""


def variants(line: str) -> list[str]:
    """A labelled line and the forms that text has besides: curly quotes, dashes, upper case, an accented name."""
    curly = line.replace("'", "’")
    first = line.split("\n")[0]
    return [line, curly, f"“{first}”", line.upper(), line.lower(), line.title(), first.replace(" ", "’s "), first.replace(" ", "’s ").upper(), f"{first} – Café", f"({first}…-Fête) — mañana ¡{first} «{first}»"]


#: Letters of other scripts that stand in for Latin ones.
_CYRILLIC = str.maketrans("aeopcxyisjhdwAEOPCXTHKMBIS", "аеорсхуіѕјһԁԝАЕОРСХТНКМВІЅ")
_GREEK = str.maketrans("oAEZHIKMNOPTXB", "οΑΕΖΗΙΚΜΝΟΡΤΧΒ")


def disguises(line: str) -> list[str]:
    """Clean lines in the odd characters that were typed, not misread: those count as clean."""
    spread = lambda mark: "".join(c + mark if i % 3 == 1 and c.isalpha() else c for i, c in enumerate(line))
    spaced = [line.replace(" ", x) for x in ("\xa0", "\u2009", "\u202f", "\u2007", "\u3000", "\t")]
    return [*spaced, *[spread(x) for x in ("\u200b", "\u200c", "\u200d", "\u200e", "\ufeff", "\u2060", "\xad")], unicodedata.normalize("NFD", line), line.translate(_CYRILLIC), line.translate(_GREEK)]


def _kind(c: str) -> int:
    """Context of a character: ASCII letter, other ASCII, letter, control, other."""
    if c < "\x7f":
        return 0 if c.isalpha() else 1
    return 2 if c.isalpha() else 3 if c <= "\x9f" else 4


def _pair_of_ascii(o: int) -> bool:
    plain = lambda b: 0x20 <= b < 0x7F or b in (9, 10, 13)
    return o < 0x10000 and plain(o & 255) and plain(o >> 8)


@dataclass
class Rules:
    """What bounds the ratios besides the counts. plain: ASCII classes; hardly: classes that typed text holds."""

    plain: np.ndarray
    hardly: np.ndarray
    styled: int
    wide: np.ndarray
    most: np.ndarray

    def __call__(self, g: np.ndarray, prev: np.ndarray, cur: np.ndarray) -> np.ndarray:
        g = np.array(g, np.float32)
        p, q = self.plain[prev][:, None], self.plain[cur][:, None]
        # plain characters mean the same in all states but the wide ones; after a garbled one they tell whether words are mixed
        g = np.where(self.wide[None, :], np.where(q, np.minimum(g, -8), g), np.where(q, np.where(p, -STAY, np.minimum(g, self.most[None, :]) - STAY), g))
        g[cur == self.styled] = -12
        g = np.where(self.hardly[prev][:, None], np.minimum(g, 1.0), g)
        return np.clip(g, -12, 12)


@dataclass
class Model:
    """The log-likelihood ratios of all states to the clean one, for pairs of character classes.

    lut: class of each code point of the basic plane. A pair that the samples or their misread forms hold has a row in
    ``seen``, found by its code in ``codes``; any other backs off to ``kind`` of the first and the second character, plus a
    term of the first, so the model grows with the classes and the pairs of a bounded sample. ``best`` is the largest ratio of
    each pair, two bytes, and ``easy`` that of the states that take less evidence to enter.
    """

    lut: np.ndarray
    kinds: np.ndarray
    codes: np.ndarray
    seen: np.ndarray
    by_kind: np.ndarray
    by_prev: np.ndarray
    best: np.ndarray
    easy: np.ndarray
    rules: Rules
    pairs: list[tuple[str, str, str]]
    enter: np.ndarray

    def classes(self, text: str) -> np.ndarray:
        """Classes of the characters of a text."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.lut[np.minimum(codes, 0xFFFF)]

    def gains(self, prev: np.ndarray, cur: np.ndarray) -> np.ndarray:
        """gain[i, s]: the ratio of state s for the i-th pair of classes."""
        out = self.rules(self.by_kind[self.kinds[prev], cur] + self.by_prev[prev], prev, cur)
        code = prev.astype(np.int64) * len(self.kinds) + cur
        at = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
        known = self.codes[at] == code
        out[known] = self.seen[at[known]]
        return out.astype(np.float16).astype(np.float32)


def fit(samples: list[str]) -> Model:
    """Estimate the emissions of all states from clean lines and from the same lines misread through every pair."""
    clean = [v for s in samples for v in variants(s)]
    odd = [d for i, s in enumerate(samples) for k, d in enumerate(disguises(s)) if (i + k) % 8 == 0]
    images = []
    for pair in PAIRS:
        rows = [(m, v) for v in clean if (m := misread(v, pair)) is not None and m != v]
        images.append([m for m, _ in rows])
    single = {c for v in clean + odd for c in v}
    for pair, rows in zip(PAIRS, images, strict=True):
        if not pair[1].startswith("utf-16"):
            single |= {c for m in rows for c in m}
            if pair[1] in _TABLES:
                single |= set(_TABLES[pair[1]])
    single = sorted(c for c in single if ord(c) < 0x2E80 or c in "�\u3000\ufeff")
    ids = {c: i for i, c in enumerate(single)}
    hangul, ascii16, styled, other = range(len(ids), len(ids) + 4)
    n = len(ids) + 4
    lut = np.full(0x10000, other, np.uint16)
    lut[0xAC00:0xD7A4] = hangul
    for o in range(0x10000):
        c = chr(o)
        if c in ids:
            lut[o] = ids[c]
        elif 0xFB00 <= o < 0xFB50 or 0xFF00 <= o < 0x10000 or 0x300 <= o < 0x370 or 0x1100 <= o < 0x1200:
            lut[o] = styled
        elif _pair_of_ascii(o) and not 0xAC00 <= o <= 0xD7A3:
            lut[o] = ascii16
    for c in "\t\u2007\u2009\u202f\u3000":  # typed spaces of other widths begin a word as the ordinary one does
        lut[ord(c)] = ids[" "]
    kinds = np.array([_kind(c) for c in single] + [2, 5, 6, 5])

    def counted(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the pairs of classes in some lines, and how often each occurs."""
        parts = [np.empty(0, np.int64)]
        for r in rows:
            k = lut[np.minimum(np.frombuffer(("\n" + r).encode("utf-32-le"), np.uint32), 0xFFFF)].astype(np.int64)
            parts.append(k[:-1] * n + k[1:])
        return np.unique(np.concatenate(parts), return_counts=True)

    def emission(codes: np.ndarray, count: np.ndarray, floor: np.ndarray, backing: float) -> tuple[np.ndarray, np.ndarray]:
        """log backing mass of cur by the kind of prev, and log total of each prev: P(cur | prev) is pairs of characters, backed
        by the context kind of prev, backed by a floor."""
        by_kind, total = np.zeros((7, n)), np.zeros(n)
        np.add.at(by_kind, (kinds[codes // n], codes % n), count)
        np.add.at(total, codes // n, count)
        by_kind = by_kind / (by_kind.sum(axis=1, keepdims=True) + 20.0) * 0.999 + floor
        return np.log(backing * by_kind), np.log(total + backing)

    def clean_floor(c: str) -> float:
        o = ord(c)
        if c == "�" or "\x80" <= c <= "\x9f" or "─" <= c <= "▟":
            return 1e-8
        if 0x300 <= o < 0x370 or unicodedata.category(c) in ("Zs", "Cf"):
            return 1e-4
        if c in "“”‘’„–—…«»¡¿":
            return 2e-3
        if c.isalpha():
            return 1e-4 if c < "\x7f" else 1e-5
        return 1e-5 if c < "\x7f" else 1e-6

    floor = np.array([clean_floor(c) for c in single] + [1e-3, 1e-8, 1e-2, 1e-6])
    plain = np.array([c < "\x7f" for c in single] + [False] * 4)
    hardly = np.array([c != "\xad" and unicodedata.category(c) == "Cf" for c in single] + [False, False, True, False])
    states = [(counted(clean + odd), floor, 4.0)]
    # the bytes of UTF-8 follow each other strictly, so a pair never seen is hardly possible there
    states += [(counted(rows), np.full(n, 1e-9), 0.3 if pair[0] == "utf-8" else 4.0) for pair, rows in zip(PAIRS, images, strict=True)]
    mass, total = zip(*[emission(*c, f, k) for c, f, k in states], strict=True)
    seen = np.unique(np.concatenate([c[0] for c, _, _ in states]))
    prev, cur = seen // n, seen % n

    def numerator(i: int) -> np.ndarray:
        """log of count and backing mass of every seen pair in a state."""
        (codes, count), _, _ = states[i]
        out = np.exp(mass[i][kinds[prev], cur])
        out[np.searchsorted(seen, codes)] += count
        return np.log(out)

    wide = np.array([p[1].startswith("utf-16") for p in PAIRS])
    most = np.array([2.0 if p[0] != "utf-8" and p[0] not in OTHER_SCRIPT else 0.0 for p in PAIRS], np.float32)
    rules = Rules(plain, hardly, styled, wide, most)
    by_kind = np.stack([m - mass[0] for m in mass[1:]], axis=2).astype(np.float32)
    by_prev = np.stack([total[0] - t for t in total[1:]], axis=1).astype(np.float32)
    base = numerator(0) - total[0][prev]
    rows = np.stack([numerator(i) - total[i][prev] - base for i in range(1, len(states))], axis=1)
    enter = np.array([ENTER_OTHER if p[0] in OTHER_SCRIPT or p in RARE else ENTER for p in PAIRS], np.float32)
    model = Model(lut, kinds, seen, rules(rows, prev, cur).astype(np.float16), by_kind, by_prev, np.empty((n, n), np.float16), np.empty((n, n), np.float16), rules, PAIRS, enter)
    every = np.arange(n)
    for k in range(n):
        g = model.gains(np.full(n, k), every)
        model.best[k], model.easy[k] = g.max(axis=1), g[:, enter < ENTER_OTHER].max(axis=1)
    return model


def peaks(model: Model, best: np.ndarray, texts: list[str]) -> np.ndarray:
    """The largest sum of ``best`` over any stretch of each text; 0 for an empty one."""
    sizes = np.array([len(t) for t in texts])
    out = np.zeros(len(texts))
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    k = model.lut[np.minimum(codes, 0xFFFF)].astype(np.int64)
    starts = np.cumsum(sizes[full]) - sizes[full]
    prev = np.empty_like(k)
    prev[1:] = k[:-1]
    prev[starts] = model.lut[10]
    g = best.astype(np.float64).ravel()[prev * best.shape[1] + k]
    c = np.cumsum(g)
    text = np.repeat(np.arange(len(full)), sizes[full])
    low = c - g - text * 1e6  # the running minimum never comes from an earlier text
    stretch = c - text * 1e6 - np.minimum.accumulate(low)
    out[full] = np.maximum.reduceat(stretch, starts)
    return out


def suspects(model: Model, texts: list[str]) -> list[int]:
    """Texts whose best path may leave the clean state; for all others the clean path is certainly the best.

    A garbled stretch has one state, so its gain is at most the largest sum over any stretch of the best state's gain per
    character, and that must exceed the cost of entering and leaving: of any state for the first bound, and for what
    passes it the cost of the states that take more evidence, or the gain of the others alone.
    """
    first = peaks(model, model.best, texts)
    some = np.flatnonzero(first > ENTER + LEAVE - 1e-3)
    easy = peaks(model, model.easy, [texts[i] for i in some])
    return some[(first[some] > ENTER_OTHER + LEAVE - 1e-3) | (easy > ENTER + LEAVE - 1e-3)].tolist()


def label(model: Model, texts: list[str], block: int = 256) -> list[np.ndarray]:
    """The most probable state of every character: 0 clean, s + 1 for pair s. Texts of like length are done together."""
    out: list[np.ndarray] = [np.empty(0, np.uint8)] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    at = 0
    while at < len(order):
        longest, group = 1, []
        while at < len(order) and len(group) < block and max(longest, len(texts[order[at]])) * (len(group) + 1) <= 400_000 or not group:
            longest = max(longest, len(texts[order[at]]))
            group.append(order[at])
            at += 1
        b, s = len(group), len(model.pairs)
        k = np.zeros((longest + 1, b), np.int64)
        k[0] = model.lut[10]
        size = np.array([len(texts[i]) for i in group])
        for j, i in enumerate(group):
            k[1 : size[j] + 1, j] = model.classes(texts[i])
        codes, where = np.unique(k[:-1] * len(model.kinds) + k[1:], return_inverse=True)
        gain, where = model.gains(codes // len(model.kinds), codes % len(model.kinds)), where.reshape(longest, b)
        bad = np.zeros((b, s), np.float32)
        ok = np.zeros(b, np.float32)
        from_clean = np.empty((longest, b, (s + 7) // 8), np.uint8)  # one bit a state
        from_bad = np.zeros((longest, b), np.uint8)
        for t in range(longest):
            enter = ok[:, None] - model.enter
            into = enter > bad if t else np.ones((b, s), bool)
            from_clean[t] = np.packbits(into, axis=1)
            if t:
                top = bad.argmax(axis=1)
                leave = bad[np.arange(b), top] - LEAVE
                swap = leave > ok
                from_bad[t] = np.where(swap, top + 1, 0)
                ok_next = np.where(swap, leave, ok)
            else:
                ok_next = ok
            bad = np.where(into, enter, bad) + gain[where[t]]
            if (ended := size == t + 1).any():
                for j in np.flatnonzero(ended):
                    last = bad[j].argmax() + 1 if bad[j].max() - LEAVE > ok_next[j] else 0
                    out[group[j]] = _trace(last, t, from_clean[:, j], from_bad[:, j])
            ok = ok_next
    return out


def _trace(state: int, t: int, from_clean: np.ndarray, from_bad: np.ndarray) -> np.ndarray:
    path = np.zeros(t + 1, np.uint8)
    while t >= 0:
        path[t] = state
        if state:
            state = 0 if from_clean[t, (state - 1) // 8] >> (7 - (state - 1) % 8) & 1 else state
        else:
            state = int(from_bad[t])
        t -= 1
    return path


def spans(path: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, state) of the garbled stretches of a path."""
    if not path.any():
        return []
    edge = np.flatnonzero(np.diff(path)) + 1
    cut = [0, *edge.tolist(), len(path)]
    return [(a, b, int(path[a])) for a, b in zip(cut, cut[1:], strict=False) if path[a]]


def _sequences_of(part: str, pairs: set[tuple[str, str, str]]) -> str:
    """A text with its runs of other than ASCII characters restored where one of the pairs restores all of them."""

    def back(run: re.Match) -> str:
        return next((x for x, whole, found in (restored(run[0], p) for p in sorted(pairs)) if whole and found), run[0])

    return re.sub(r"[^\x00-\x7f]{2,}", back, part) if pairs and not part.isascii() else part


def repair(model: Model, text: str, path: np.ndarray) -> tuple[str, bool, list[int]]:
    """The text with every labelled stretch passed through its state's inverse, whether all of it could be restored, and
    the states used. A stretch without a sequence of its encoding, one that the inverse leaves alone, and one whose inverse
    mixes scripts within a word are not garbled and stay. Between the stretches, runs that are whole UTF-8 sequences of a state
    used in the text get its inverse too: the samples need not have held their characters."""
    out, done, whole, used = [], 0, True, []
    for a, b, s in spans(path):
        back, ok, found = restored(text[a:b], model.pairs[s - 1])
        mixed = model.pairs[s - 1][0] in OTHER_SCRIPT and _MIXED.search(back)
        if found and not mixed and (back != text[a:b] or model.pairs[s - 1][1] == "utf-8"):
            out += [(text[done:a], True), (back, False)]
            done = b
            whole &= ok
            used.append(s)
    out.append((text[done:], True))
    again = {model.pairs[s - 1] for s in used if model.pairs[s - 1][0] == "utf-8" and model.pairs[s - 1][1] in _TABLES and not model.pairs[s - 1][2]}
    return "".join(_sequences_of(part, again) if gap else part for part, gap in out), whole, used


def clean_mask(model: Model, texts: list[str]) -> dict[int, np.ndarray]:
    """Paths of the texts that are garbled somewhere, by position."""
    some = suspects(model, texts)
    paths = label(model, [texts[i] for i in some])
    return {i: p for i, p in zip(some, paths, strict=True) if p.any()}


def samples_of(lang_samples: DataFrame) -> list[str]:
    """Correctly labelled lines to fit on, at most SAMPLES_PER_LANGUAGE of each language, the smallest ids first."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rank = F.row_number().over(Window.partitionBy("lang").orderBy("sample_id"))
    rows = lang_samples.where("text <> ''").withColumn("_k", rank).where(F.col("_k") <= SAMPLES_PER_LANGUAGE).orderBy("sample_id").select("text").collect()
    return [r["text"] for r in rows]


def repaired_fields(songs: DataFrame, lang_samples: DataFrame, fields: tuple[str, ...] = ("title", "plain_lyrics"), key: str = "song_index") -> DataFrame:
    """(key, field_name, restored_text, restored, encodings) of every garbled field.

    ``restored`` is false where some stretch is lost; that stretch is kept as it is. ``encodings`` names the pairs.
    Null and empty fields are never garbled; a row delivered twice gives equal rows.
    """
    model = songs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(fit(samples_of(lang_samples))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(model.value)
        for batch in batches:
            ids, names, texts, whole, codes = [], [], [], [], []
            keys = batch.column(0)
            for f, name in enumerate(fields):
                values = [x or "" for x in batch.column(f + 1).to_pylist()]
                for i, path in clean_mask(m, values).items():
                    text, ok, used = repair(m, values[i], path)
                    if not used:
                        continue
                    ids.append(keys[i].as_py())
                    names.append(name)
                    texts.append(text)
                    whole.append(ok)
                    codes.append(sorted({">".join(x for x in m.pairs[s - 1] if x) for s in used}))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(whole, pa.bool_()), pa.array(codes, pa.list_(pa.string()))],
                names=[key, "field_name", "restored_text", "restored", "encodings"],
            )

    schema = f"{key} bigint, field_name string, restored_text string, restored boolean, encodings array<string>"
    return songs.select(key, *fields).mapInArrow(scan, schema)


def garbled_fields(songs: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """(song_index, field_name) of every field that is garbled in whole or in part, once."""
    return repaired_fields(songs, lang_samples).where("song_index is not null").select("song_index", "field_name").distinct()
