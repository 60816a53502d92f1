"""Visually identical text with different characters: one canonical form, by SQL inside Arrow partitions."""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

#: Letters of other scripts that look like Latin ones.
TO_LATIN = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԝ": "w", "ԛ": "q", "ӏ": "l", "ү": "y", "ё": "ë", "ї": "ï", "к": "k",
    "А": "A", "В": "B", "Е": "E", "З": "3", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "Ԍ": "G", "Ԝ": "W", "Ԛ": "Q", "Ё": "Ë", "Ї": "Ï", "Һ": "H", "Ү": "Y",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "ϲ": "c", "ϳ": "j", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "ɡ": "g", "ɑ": "a", "ı": "i",
}
#: Latin letters that look like Cyrillic ones.
TO_CYRILLIC = dict(zip("aeopcxykAEOPCXYBHKMT3ëË", "аеорсхукАЕОРСХУВНКМТЗёЁ", strict=True))
#: Invisible characters, and spaces that are no ordinary space.
INVISIBLE = r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}"
SPACES = r"\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
#: Characters that have a compatibility decomposition and stay all the same: ordinary letters of Armenian, Thai,
#: Lao, Tibetan and Arabic, and the ellipsis.
ORDINARY = "և ำ ຳ ໜ ໝ ༌ ཷ ཹ ٵ ٶ ٷ ٸ …".split()
#: Kinds of forms that look different from what they stand for, and signs that are ordinary in text. They stay unless
#: all of FORMS is asked for; misread text is full of them, and could not be restored without.
PLAIN_KINDS, PLAIN_SIGNS = ("<super>", "<sub>", "<fraction>", "<circle>"), "µ№℃℉℡™℠‥‼⁇⁈⁉″‴⁗‶‷"


def _forms() -> dict[str, str]:
    """Every character with a compatibility decomposition and the ordinary characters it stands for; spaces and spacing accents are left out."""
    out = {}
    for o in range(0x80, 0x30000):
        c = chr(o)
        if not unicodedata.decomposition(c).startswith("<") or c in ORDINARY:
            continue
        k = unicodedata.normalize("NFKC", c)
        if k != c and k[0] != " " and k.strip():
            out[c] = k
    return out


FORMS = _forms()
DISGUISES = {c: k for c, k in FORMS.items() if c not in PLAIN_SIGNS and unicodedata.decomposition(c).split()[0] not in PLAIN_KINDS}


def _class(chars: Iterable[str]) -> str:
    """The inside of a character class, as ranges."""
    out: list[list[int]] = []
    for o in sorted(map(ord, chars)):
        if out and o == out[-1][1] + 1:
            out[-1][1] = o
        else:
            out.append([o, o])
    return "".join(f"\\x{{{a:04X}}}" + (f"-\\x{{{b:04X}}}" if b > a else "") for a, b in out)


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _letters(lo: int, hi: int, without: dict[str, str] | str) -> str:
    """The inside of a character class of the letters of a range that are not look-alikes."""
    return _class(chr(o) for o in range(lo, hi + 1) if unicodedata.category(chr(o)).startswith("L") and chr(o) not in without)


def _translate(sql: str, table: dict[str, str]) -> str:
    """SQL that replaces single characters by single characters."""
    return f"translate({sql}, {_quote(''.join(table))}, {_quote(''.join(table.values()))})"


_OTHER = r"[\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}\p{Lisu}ɡɑı]"
_OTHER_OWN = f"[{_letters(0x370, 0x58F, TO_LATIN)}{_letters(0x13A0, 0x13FF, TO_LATIN)}{_letters(0xA4D0, 0xA4FF, TO_LATIN)}]"
_LATIN_OWN = f"[{_letters(0x41, 0x24F, ''.join(TO_CYRILLIC) + 'siIjJSdwqhl')}]"
_CYRILLIC_OWN = f"[{_letters(0x400, 0x52F, TO_LATIN)}]"


def canonical_sql(column: str, table: str, forms: dict[str, str]) -> str:
    """SQL for DuckDB: the canonical form of a text column of a relation, in row order as a column ``c``.

    The variable ``forms`` of the connection maps compatibility forms, the keys of ``forms``, to ordinary characters.

    Compatibility forms, composed accents, invisible characters and odd spaces first; then look-alike letters. A word
    with letters that only Cyrillic or Greek has is of that script, and Latin twins in it are turned; any other word with
    such letters beside Latin ones is Latin. A word of nothing but twins follows the rest of its text.
    """
    one = _class(forms)
    parts = f"list_transform(regexp_extract_all(t, '[{one}]|[^{one}]+'), lambda x: coalesce(map_extract(getvariable('forms'), x)[1], x))"
    known = f"CASE WHEN regexp_matches(t, '[{one}]') THEN array_to_string({parts}, '') ELSE t END"
    clean = f"nfc_normalize(regexp_replace(regexp_replace(f, '[{INVISIBLE}]+', '', 'g'), '[{SPACES}]', ' ', 'g'))"
    word = f"""CASE
        WHEN NOT regexp_matches(w, '\\p{{L}}') THEN w
        WHEN regexp_matches(w, '{_OTHER}') THEN CASE
            WHEN NOT regexp_matches(w, '{_OTHER_OWN}') AND (regexp_matches(w, '\\p{{Latin}}') AND NOT (cyr AND NOT regexp_matches(w, '{_LATIN_OWN}')) OR NOT other) THEN {_translate('w', TO_LATIN)}
            WHEN regexp_matches(w, '\\p{{Latin}}') AND regexp_matches(w, '\\p{{Cyrillic}}') AND NOT regexp_matches(w, '{_LATIN_OWN}') THEN {_translate('w', TO_CYRILLIC)}
            WHEN regexp_matches(w, '\\p{{Latin}}') THEN {_translate('w', TO_LATIN)}
            ELSE w END
        WHEN cyr AND NOT latin AND NOT regexp_matches(w, '{_LATIN_OWN}|[siIjJSdwqhl]') THEN {_translate('w', TO_CYRILLIC)}
        ELSE w END"""
    return f"""
WITH a AS (SELECT row_number() OVER () AS i, {column} AS t FROM {table}),
b AS (SELECT i, {known} AS f FROM a),
c AS (SELECT i, {clean} AS n FROM b),
d AS (SELECT i, n, regexp_matches(n, '{_OTHER}') AND regexp_matches(n, '\\p{{Latin}}') AS both_scripts FROM c),
e AS (SELECT i, n, regexp_matches(n, '{_LATIN_OWN}') AS latin, regexp_matches(n, '{_OTHER_OWN}') AS other, regexp_matches(n, '{_CYRILLIC_OWN}') AS cyr FROM d WHERE both_scripts),
g AS (SELECT i, nfc_normalize(array_to_string(list_transform(regexp_extract_all(n, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'), lambda w: {word}), '')) AS n FROM e)
SELECT d.i, CASE WHEN d.both_scripts THEN g.n ELSE d.n END AS c FROM d LEFT JOIN g ON d.i = g.i ORDER BY d.i"""


class Canonical:
    """One DuckDB connection of one thread, for the batches of a task; ``forms`` are the compatibility forms to take out, those
    that look like something else unless given; FORMS are all."""

    def __init__(self, forms: dict[str, str] | None = None) -> None:
        import duckdb

        forms = DISGUISES if forms is None else forms
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB"})
        self.con.register("forms", pa.table({"form": list(forms), "plain": list(forms.values())}))
        self.con.execute("SET VARIABLE forms = (SELECT map(list(form), list(plain)) FROM forms)")
        self.sql = canonical_sql("t", "batch", forms)

    def __call__(self, texts: pa.Array) -> pa.Array:
        """Canonical forms, in order; null stays null."""
        self.con.register("batch", pa.table({"t": texts.cast(pa.string())}))
        try:
            out = self.con.sql(self.sql).to_arrow_table().column("c")
        finally:
            self.con.unregister("batch")
        return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def canonical_fields(songs: DataFrame, key: str = "song_index", fields: tuple[str, ...] = ("title", "plain_lyrics"), every_form: bool = False) -> DataFrame:
    """``key`` and ``fields``, each text in its canonical form. Null stays null and empty stays empty; whole texts are read.

    With ``every_form`` all compatibility forms are taken out, also those that look different, such as superscripts; text
    from wrong decoding has to be restored before that.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = Canonical(FORMS if every_form else None)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *[canonical(b.column(i + 1)) for i in range(len(fields))]], names=[key, *fields])

    return songs.select(key, *fields).mapInArrow(scan, f"{key} bigint, " + ", ".join(f"{f} string" for f in fields))


def disguised_fields(songs: DataFrame, lang_samples: DataFrame, key: str = "song_index", fields: tuple[str, ...] = ("title", "plain_lyrics")) -> DataFrame:
    """(key, field_name) of every field that its canonical form changes, once.

    Characters that wrong decoding produced do not count: a changed text is labelled by the hidden Markov model of the
    encoding operator, its garbled stretches are blanked, and it counts if the canonical form still changes it.
    """
    from stanzaflow.llm.encoding import Model, clean_mask, fit, repair, samples_of, spans

    shared = songs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(fit(samples_of(lang_samples))))

    def blanked(model: Model, text: str, path: np.ndarray) -> str:
        used = set(repair(model, text, path)[2])
        chars = list(text)
        for a, b, s in spans(path):
            if s in used:
                chars[a:b] = " " * (b - a)
        return "".join(chars)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical, model = Canonical(), pickle.loads(shared.value)
        for batch in batches:
            keys, ids, names = batch.column(0).to_pylist(), [], []
            for f, name in enumerate(fields):
                texts = batch.column(f + 1)
                changed = [i for i, (x, y) in enumerate(zip(texts.to_pylist(), canonical(texts).to_pylist(), strict=True)) if x != y]
                if not changed:
                    continue
                values = [texts[i].as_py() for i in changed]
                paths = clean_mask(model, values)
                again = [k for k in paths if repair(model, values[k], paths[k])[2]]
                if again:
                    masked = [blanked(model, values[k], paths[k]) for k in again]
                    same = {k for k, m, c in zip(again, masked, canonical(pa.array(masked, pa.string())).to_pylist(), strict=True) if m == c}
                    changed = [i for k, i in enumerate(changed) if k not in same]
                ids += [keys[i] for i in changed]
                names += [name] * len(changed)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string())], names=[key, "field_name"])

    found = songs.select(key, *fields).mapInArrow(scan, f"{key} bigint, field_name string")
    return found.where(f"{key} is not null").distinct()
