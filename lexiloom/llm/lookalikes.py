"""One consistent form for texts that look the same."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import checkpointed

# Letters of other scripts drawn as Latin ones, and what they are drawn as.
_DRAWN_AS = {
    "АВЕЅІЈКМНОРСТХУӀӔԌԜ": "ABESIJKMHOPCTXYIÆGW",
    "аеоѕіјрсхуԁԛԝһӏѵѡӕүց": "aeosijpcxydqwhlvwæyg",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ": "ABEZHIKMNOPTYXCJ",
    "αοινρϲϳ": "aoivpcj",
    "ɑɡı": "agı",
    "ՕՍՏԼ": "OUSL",
    "օոսհ": "onuh",
    "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏔᏙᏚᏞᏟᏢᏦ": "DRTAJEWMHYGZRWVSLCPK",
    "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ": "BPDTGKJCZFMNLSRVHWXYAEIOU",
    "ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ": "ABEHIKMNOPCTYX",
    "ⲟⲣⲥ": "opc",
}
# Hyphens drawn alike (not dashes or the minus sign).
_HYPHENS = "‐‑﹣－"
# Characters without a mark on the page, besides the format characters (category Cf).
_UNSEEN = "͏ᅟᅠ឴឵ㅤﾠ"
_BLANK, _LINE = 0x20, 0x0A
_WORK = 1 << 18  # code points worked on at once
_SAME = {"<wide>", "<narrow>", "<noBreak>", "<compat>"}
_HANGUL = range(0xAC00, 0xAC00 + 11172)


def _decomposition(ch: str) -> str | None:
    """What a character is composed of, fonts, positions and fractions apart."""
    d = unicodedata.decomposition(ch)
    if not d:
        return None
    tag, *codes = d.split() if d[0] == "<" else ("", *d.split())
    if tag == "<compat>":  # ligatures, digraphs and Roman numerals: letters that stand for several, or a numeral for one
        out = "".join(chr(int(c, 16)) for c in codes)
        if not ("ﬀ" <= ch <= "ﭏ" or "Ⅰ" <= ch <= "ⅿ" or ch == "µ" or len(out) > 1 and ch.isalpha() and out.isalpha()):
            return None
    elif tag and tag not in _SAME:
        return None
    return "".join(chr(int(c, 16)) for c in codes)


@cache
def mapping() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, targets, classes, pairs) over all code points: what each becomes, its combining class, and what pairs compose.

    The table is made by rule from the Unicode data of Python's unicodedata and has a fixed size.
    """
    to = {}
    blanks = {c for c in map(chr, range(0x110000)) if c.isspace() or unicodedata.category(c) == "Zs"} | {"⠀"}
    for code in range(0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        if code in _HANGUL:  # syllables stay taken apart
            at = code - _HANGUL.start
            to[code] = [0x1100 + at // 588, 0x1161 + at % 588 // 28] + ([0x11A7 + at % 28] if at % 28 else [])
            continue
        ch = chr(code)
        category = unicodedata.category(ch)
        if ch in "\n\v\f\x85\u2028\u2029":
            to[code] = [_LINE]
        elif ch in blanks:
            to[code] = [_BLANK]
        elif category == "Cf" or ch in _UNSEEN or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            to[code] = []
        elif _decomposition(ch) is not None:
            to[code] = [ord(ch)]
    for code, start in list(to.items()):
        if start == [code]:
            out = chr(code)
            while True:
                longer = "".join(c if (d := _decomposition(c)) is None else d for c in out)
                if longer == out:
                    break
                out = longer
            to[code] = [ord(c) for c in out]
    drawn = {ord(a): ord(b) for group, latin in _DRAWN_AS.items() for a, b in zip(group, latin, strict=True)} | {ord(c): ord("-") for c in _HYPHENS}
    for code in drawn:
        to.setdefault(code, [code])
    blank_codes = {ord(c) for c in blanks}
    to = {code: [c if c == _LINE else _BLANK if c in blank_codes else drawn.get(c, c) for c in out] for code, out in to.items()}

    lengths = np.ones(0x110000, np.int32)
    for code, out in to.items():
        lengths[code] = len(out)
    ends = np.cumsum(lengths, dtype=np.int32)
    offsets = ends - lengths
    targets = np.zeros(ends[-1], np.uint32)
    targets[offsets[lengths == 1]] = np.nonzero(lengths == 1)[0]
    for code, out in to.items():
        targets[offsets[code] : offsets[code] + len(out)] = out
    classes = np.array([0 if 0xD800 <= c < 0xE000 else unicodedata.combining(chr(c)) for c in range(0x110000)], np.uint8)

    pairs = []
    for code in range(0x110000):
        d = "" if 0xD800 <= code < 0xE000 else unicodedata.decomposition(chr(code))
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", chr(code)) == chr(code):
            a, b = (int(c, 16) for c in d.split())
            pairs.append((a << 21 | b, code))
    pairs.sort()
    return np.append(offsets, ends[-1:]), targets, classes, np.array(pairs, np.int64)


def canonical_codes(codes: np.ndarray, rows: np.ndarray, table) -> tuple[np.ndarray, np.ndarray]:
    """Code points of many texts, with the row of each, in canonical form."""
    offsets, targets, classes, pairs = table
    # Explode: each positioned code point becomes what the table says.
    first = offsets[codes]
    size = offsets[codes + np.uint32(1)] - first
    ends = np.cumsum(size)
    at = np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    codes, rows = targets[at], np.repeat(rows, size)
    if not len(codes):
        return codes, rows

    # Order marks by class behind their starter; a starter is any code point of class 0 or a row's first.
    cls = classes[codes]
    new_row = np.append(True, rows[1:] != rows[:-1])
    if cls.any():
        cluster = np.cumsum((cls == 0) | new_row)
        marked = np.zeros(cluster[-1] + 1, bool)
        marked[cluster[cls > 0]] = True
        hit = np.nonzero(marked[cluster])[0]
        order = np.lexsort((hit, np.where((cls[hit] == 0), 0, cls[hit]), cluster[hit]))
        codes = codes.copy()
        codes[hit] = codes[hit[order]]
        cls = classes[codes]
        codes, keep = _recompose(codes, cls, cluster, hit, pairs)
        codes, rows = codes[keep], rows[keep]

    # A run of blanks is one blank, or the one or two line breaks that it holds; none stay at a row's ends.
    new_row = np.append(True, rows[1:] != rows[:-1])
    line = codes == _LINE
    white = line | (codes == _BLANK)
    begins = white & (~np.append(False, white[:-1]) | new_row)
    run = np.cumsum(begins) - 1
    places = np.nonzero(white)[0]
    if len(places):
        lines = np.bincount(run[places], weights=line[places]).astype(np.int64)
        lines_before = np.cumsum(line) - line
        nth = lines_before - lines_before[np.nonzero(begins)[0]][run]
        last_row = np.append(new_row[1:], True)
        run_edge = new_row[np.nonzero(begins)[0]].copy()
        run_edge[run[places[last_row[places]]]] = True
        good = np.where(lines[run] > 0, line & (nth < 2), begins) & ~run_edge[run]
        keep = ~white | good
        codes, rows = codes[keep], rows[keep]
    return codes, rows


def _recompose(codes, cls, cluster, hit, pairs):
    """Join each starter with the marks that it composes with; returns the codes and which of them stay."""
    keep = np.ones(len(codes), bool)
    start, blocked = hit[0], 0
    keys, made = pairs[:, 0], pairs[:, 1]
    for i in hit:
        if i == start or cluster[i] != cluster[start]:
            start, blocked = i, 0
            continue
        c = cls[i]
        if blocked < c:
            key = int(codes[start]) << 21 | int(codes[i])
            at = np.searchsorted(keys, key)
            if at < len(keys) and keys[at] == key:
                codes[start] = made[at]
                keep[i] = False
                continue
        blocked = c
    return codes, keep


def _some(texts: pa.Array) -> Iterator[list[str]]:
    """Texts in groups of about _WORK code points."""
    group, size = [], 0
    for text in texts:
        group.append(text.as_py())
        size += len(group[-1])
        if size >= _WORK:
            yield group
            group, size = [], 0
    if group:
        yield group


def canonical(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, raw, canonical), raw being the text's hash: one form for all texts that a reader can't tell apart, different forms for others.

    Method: texts are exploded to positioned code points; a table of fixed size, sent to every task, gives
    each one's decomposition (full, half and no-break widths, ligatures, composed letters), the Latin letter
    it is drawn as, and that invisible characters vanish and blanks of any kind and width are one (line breaks and
    blank lines stay); combining marks are ordered by class, recomposed with their letters (Hangul syllables stay taken apart), and
    strings are rebuilt. The rows of this
    join never leave their task: they are columns of numpy arrays per Arrow batch, for as Spark rows they
    would be shuffled at many times the text's size.

    Case, letters, accents, digits, marks and words stay different, as do long s and letters in another font.
    Letters of Cyrillic, Greek, Armenian, Cherokee, Lisu and Coptic that are drawn as Latin ones are those.
    Null texts stay null; empty ones, and those of blanks and invisible characters only, become ''. Repeated
    rows are kept; other columns are ignored. Texts are whole, of any length.
    """
    table = texts.sparkSession.sparkContext.broadcast(mapping())
    kind = texts.schema[key].dataType.simpleString()
    named = texts.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("raw"), F.regexp_replace(F.col(f"`{text}`"), "\r\n?", "\n").alias("text"))
    # Printable ASCII with single blanks inside is canonical as it stands.
    plain = F.col("text").isNull() | ((F.octet_length("text") == F.length("text")) & ~F.col("text").rlike(r"[\x00-\x1f\x7f]|^ | $|  "))
    kept = named.where(plain).select("key", "raw", F.col("text").alias("canonical"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bodies in _some(batch["text"]):
                codes = np.frombuffer("".join(bodies).encode("utf-32-le", "surrogatepass"), np.uint32)
                rows = np.repeat(np.arange(len(bodies), dtype=np.int32), [len(b) for b in bodies])
                codes, rows = canonical_codes(codes, rows, table.value)
                ends = np.searchsorted(rows, np.arange(len(bodies)), "right")
                whole = codes.tobytes().decode("utf-32-le", "surrogatepass")
                start = 0
                for end in ends.tolist():
                    out.append(whole[start:end])
                    start = end
            yield pa.RecordBatch.from_arrays([batch["key"], batch["raw"], pa.array(out, pa.string())], ["key", "raw", "canonical"])

    done = named.where(~plain).mapInArrow(rewrite, f"key {kind}, raw long, canonical string")
    return kept.unionByName(done).withColumnRenamed("key", key)


def alike_pairs(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(id_a, id_b): pairs of keys, id_a < id_b, with different texts of one canonical form.

    Texts travel as two hashes (of the form, of the text). Groups of a form with only one text, however many
    rows share it, are dropped by an aggregation that combines before the shuffle; the rest is an equi-join,
    split by Spark where one form is frequent. Null, empty and blank texts take no part; repeated rows count
    once.
    """
    forms = canonical(texts, key, text).where(F.col(key).isNotNull() & (F.length("canonical") > 0))
    hashed = forms.select(F.col(key).alias("id"), F.xxhash64("canonical").alias("form"), F.hash("canonical").alias("form2"), "raw").distinct()
    hashed = checkpointed(hashed)
    several = hashed.groupBy("form", "form2").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("form", "form2")
    rows = hashed.join(several, ["form", "form2"], "left_semi")
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col("a.form") == F.col("b.form")) & (F.col("a.form2") == F.col("b.form2"))
    pairs = a.join(b, same & (F.col("a.id") < F.col("b.id")) & (F.col("a.raw") != F.col("b.raw")))
    return pairs.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()


def alike_classes(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(form, id, n_links): each key whose text looks like a different one, its form's hash, and how many keys it is linked to.

    One row per key stands for all pairs of ``alike_pairs``: within a form, all keys of different texts.
    """
    forms = canonical(texts, key, text).where(F.col(key).isNotNull() & (F.length("canonical") > 0))
    hashed = checkpointed(forms.select(F.col(key).alias("id"), F.sha2("canonical", 256).alias("form"), "raw").distinct())
    texts_of = hashed.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("same"))
    sizes = texts_of.groupBy("form").agg(F.sum("same").alias("all"), F.count(F.lit(1)).alias("texts")).where("texts > 1")
    links = texts_of.join(sizes, "form").select("form", "raw", (F.col("all") - F.col("same")).alias("n_links"))
    return hashed.join(links, ["form", "raw"]).groupBy("form", "id").agg(F.sum("n_links").alias("n_links"))
