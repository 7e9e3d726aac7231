"""Linking the spellings of one person or organisation."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.session import checkpointed

#: Shortest suffix of a token that is indexed.
SUFFIX = 4
#: Names of a tile, about; larger blocks are compared by pairs of tiles. No result depends on it.
BLOCK = 256
#: Least ratio of the longest common subsequence for two spellings of one word.
ALIKE = 0.8
#: A given name so many times rarer than another may be that one with two typing errors.
RARER = 8

# Words before, after and around a name.
_TITLES = {"dr", "rev", "prof", "capt", "mr", "mrs", "ms", "miss", "sir", "col", "gen", "lt", "sgt", "fr", "mme", "mlle", "herr", "frau", "don", "dona"}
_GENERATIONS = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "younger": "jr", "elder": "sr", "ii": "ii", "iii": "iii", "iv": "iv"}
_ORG_TAILS = {"ltd", "inc", "co", "llc", "plc", "gmbh", "corp", "limited"}
_SMALL = {"the", "of", "and", "for", "de", "der", "du"}
_PARTICLES = "de|del|della|der|den|des|di|do|dos|du|da|la|le|los|van|von|vom|zu|zum|zur|ten|ter|af|av|al|el|bin|ibn"
_DETERMINERS = "the|a|an|this|that|these|those|such|both|some|any|every|each|all|my|your|his|her|its|our|their|one|two|three"


def fold(word: str) -> str:
    plain = unicodedata.normalize("NFKD", word.replace("ß", "ss")).casefold()
    return "".join(c for c in plain if c.isalnum() or c in ".")


@lru_cache(1 << 16)
def ratio(a: str, b: str) -> float:
    """2 * LCS / (len(a) + len(b)), the subsequence counted in the bits of one number."""
    if not a or not b:
        return 0.0
    places: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        places[c] |= 1 << i
    row = (1 << len(a)) - 1
    for c in b:
        hit = row & places[c]
        row = (row + hit | row - hit) & ((1 << len(a)) - 1)
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def alike(a: str, b: str) -> bool:
    return a == b or min(len(a), len(b)) >= 3 and ratio(a, b) >= ALIKE


@lru_cache(1 << 16)
def edits(a: str, b: str, swaps: bool = True) -> int:
    """Letters added, left out or exchanged, and, with ``swaps``, neighbours swapped, that make b of a."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        earlier, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            least = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if swaps and i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                least = min(least, earlier[j - 2] + 1)
            row.append(least)
    return row[-1]


def _swapped(a: str, b: str) -> bool:
    """Whether two typing errors, of which one at least swaps neighbours, make one long word of the other; two names are seldom so alike."""
    return min(len(a), len(b)) >= 6 and abs(len(a) - len(b)) < 2 and edits(a, b) <= 2 and edits(a, b) < edits(a, b, False)


def _same_last(a: str, b: str) -> bool:
    return a == b or alike(a, b) and edits(a, b) <= 2 or _swapped(a, b)


@dataclass
class Name:
    text: str
    n: int
    org: bool
    given: list[str] = field(default_factory=list)  # of a person: given names, initials and short forms
    last: str = ""
    generation: str = ""
    titled: bool = False
    words: list[str] = field(default_factory=list)  # of an organisation
    nick: frozenset = frozenset()  # full forms of the first given name, if that is a known short form
    independent: bool = False  # the first given name is known to be a full one
    often: int = 0  # how many names of the corpus begin with the first given name


def parse(text: str, n: int, org: bool, short: dict[str, frozenset], full: Iterable[str] = (), often: int = 0) -> Name:
    """The parts of a name as stored: titles off, 'Last, First' turned round, generation marks apart."""
    if org:
        words = [fold(w) for w in re.split(r"[\s\-]+", text.strip().strip(",")) if fold(w)]
        while len(words) > 1 and words[-1].rstrip(".") in _ORG_TAILS:
            words.pop()
        if "of" in words[1:-1]:
            at = words.index("of")
            words = words[at + 1 :] + words[:at]
        words = [w for w in words if w not in _SMALL]
        return Name(text, n, True, words=words if len(words) > 1 else [w.replace(".", "") for w in words])
    head, comma, rest = text.partition(",")
    if comma and fold(rest).strip(". ") not in _GENERATIONS:
        text_in_order = rest + " " + head
    else:
        text_in_order = text.replace(",", " ")
    words = [fold(w) for w in text_in_order.split() if fold(w).strip(".")]
    titled = generation = ""
    while len(words) > 1 and words[0].rstrip(".") in _TITLES:
        titled = words.pop(0)
    while len(words) > 1 and words[-1].rstrip(".") in _GENERATIONS:
        generation = _GENERATIONS[words.pop().rstrip(".")]
        if words[-1] == "the" and len(words) > 1:
            words.pop()
    given = words[:-1]
    nick = short.get(given[0], frozenset()) if given else frozenset()
    return Name(text, n, False, given=given, last=words[-1] if words else "", generation=generation, titled=bool(titled), nick=nick, independent=bool(given) and given[0] in full, often=often)


def _cut(word: str) -> bool:
    """An initial or an abbreviation."""
    return word.endswith(".") or len(word) == 1


def _same_word(a: str, b: str) -> bool:
    """Equal but for typing errors, or one cut short."""
    if _cut(a) or _cut(b):
        x, y = sorted((a.rstrip("."), b.rstrip(".")), key=len)
        rest = iter(y)
        return y.startswith(x) or x[:1] == y[:1] and len(x) > 2 and len(y) > 4 and all(c in rest for c in x)
    return alike(a, b)


def _same_given(a: Name, b: Name) -> bool:
    x, y = a.given[0], b.given[0]
    if _same_word(x, y) or not _cut(x) and not _cut(y) and _misspelt(x, y, a.often, b.often):
        return True
    for nick, other in ((a.nick, y), (b.nick, x)):
        if any(_same_word(f, other) for f in nick):
            return True
    return bool(a.nick & b.nick)


def _misspelt(x: str, y: str, often_x: int, often_y: int) -> bool:
    """Whether one given name is the other with more typing errors than ``alike`` allows: a rare one beside a frequent one, or with swapped letters."""
    if _swapped(x, y):
        return True
    rare = max(often_x, often_y) >= RARER * max(1, min(often_x, often_y))
    return rare and min(len(x), len(y)) >= 4 and abs(len(x) - len(y)) < 3 and edits(x, y) <= (2 if min(len(x), len(y)) > 4 else 1)


def compatible(a: Name, b: Name) -> bool:
    """Whether two names can be the same one's, the other names of the project apart."""
    if a.org != b.org:
        return False
    if a.org:
        return _same_org(a.words, b.words)
    if not _same_last(a.last, b.last) or a.generation != b.generation and a.given and b.given:
        return False
    if not a.given or not b.given:
        return True
    if not _same_given(a, b) and not _short_form(a, b):
        return False
    exact = (a.given[0], a.last) == (b.given[0], b.last)
    return all(_same_word(x, y) or exact and _mistyped(x, y) for x, y in zip(a.given[1:], b.given[1:], strict=False))


def _short_form(a: Name, b: Name) -> bool:
    """Whether one given name looks like an unlisted short form of the other."""
    for x, y in ((a, b), (b, a)):
        s, f = x.given[0], y.given[0]
        if len(x.given) > 1 or x.independent or x.nick or not 3 <= len(s) <= 6 or _cut(s) or _cut(f) or len(f) <= len(s):
            continue
        rest = iter(f)
        if s[:2] == f[:2] or s[0] == f[0] and s.endswith(("y", "ie")) or len(s) >= 4 and all(c in rest for c in s):
            return True
    return False


def _same_org(a: list[str], b: list[str]) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1 and len(b) > 1:
        return a[0].replace(".", "") == "".join(w[0] for w in b)
    if len(a) < 2 and a != b:
        return len(a) == len(b) == 1 and alike(a[0], b[0])
    same = _same_word(a[0], b[0]) if _cut(a[0]) or _cut(b[0]) else _same_last(a[0], b[0])
    return same and all(_same_word(x, y) or a[0] == b[0] and _mistyped(x, y) for x, y in zip(a[1:], b[1:], strict=False)) and (len(a) == len(b) or len(b) - len(a) == 1)


def _mistyped(a: str, b: str) -> bool:
    """Whether words in names that are the same besides differ by typing errors that ``_same_word`` doesn't know: in a short word, or in an abbreviation."""
    if _cut(a) == _cut(b):
        return not _cut(a) and min(len(a), len(b)) >= 4 and edits(a, b) <= 1 + (min(len(a), len(b)) > 5)
    x, y = (a.rstrip("."), b) if _cut(a) else (b.rstrip("."), a)
    return len(x) > 2 and len(y) > 3 and x[0] == y[0] and any(_within(x[:i] + x[i + 1 :], y) for i in range(1, len(x)))


def _within(a: str, b: str) -> bool:
    """Whether a's letters stand in b in their order."""
    rest = iter(b)
    return all(c in rest for c in a)


def _backing(names: list[Name]) -> list[int]:
    """With how many others each name is compatible that have its last or first given name, or the first or all further words of an organisation: the right spelling is with most, if each misspelt one errs in its own way."""
    by: dict[tuple, list[int]] = defaultdict(list)
    for i, name in enumerate(names):
        for key in (("head", *name.words[:1]), ("tail", *name.words[1:])) if name.org else (("last", name.last), ("given", *name.given[:1])):
            by[key].append(i)
    near: list[set[int]] = [set() for _ in names]
    for key, members in by.items():
        for i, j in combinations(members, 2) if key[1:] else ():
            if j not in near[i] and compatible(names[i], names[j]):
                near[i].add(j)
                near[j].add(i)
    return [len(x) for x in near]


def _strength(name: Name, backing: int) -> tuple:
    """Fuller names come first; of equal ones, those with more backing, then the frequent."""
    if name.org:
        return (-len(name.words) if len(name.words) > 1 else 0, sum(_cut(w) for w in name.words), -backing, -name.n, name.text)
    weak = not name.given or _cut(name.given[0]) or bool(name.nick)
    cut = sum(_cut(w) for w in name.given)
    maybe = bool(name.given) and len(name.given[0]) <= 6 and not name.independent
    return (weak, not name.given, maybe, -(len(name.given) - cut), cut, not name.independent, -backing, -name.often, -name.n, name.text)


def _weak(name: Name) -> bool:
    if name.org:
        return len(name.words) < 3 or any(_cut(w) for w in name.words)
    return not name.given or any(_cut(w) for w in name.given) or bool(name.nick) or len(name.given[0]) <= 6 and not name.independent


def resolve(names: list[Name]) -> list[list[Name]]:
    """Groups of names of one person or organisation.

    From full names to short ones; a name joins the one group with whose fullest name, and all others, it is
    compatible. If it is with several groups, those whose last name (or organisation's words) it spells as one
    of them does, or most nearly so, are left, then those with the nearest given name. If there still are several, it tells nobody
    and stays with its like.
    """
    groups: list[list[Name]] = []
    strengths = [_strength(*pair) for pair in zip(names, _backing(names), strict=True)]
    for name in (names[i] for i in sorted(range(len(names)), key=strengths.__getitem__)):
        fits = [g for g in groups if compatible(name, g[0]) and 2 * sum(compatible(name, other) for other in g) >= len(g)]
        fits = _nearest(fits, lambda other, name=name: _apart(name, other))
        close = [g for g in fits if not name.org and name.given and g[0].given and not _cut(name.given[0]) and alike(name.given[0], g[0].given[0])]
        fits = _nearest(close, lambda other, name=name: edits(name.given[0], other.given[0]) if other.given and not _cut(other.given[0]) else len(name.given[0])) if len(fits) > 1 and close else fits
        exact = [g for g in fits if (g[0].given, g[0].last, g[0].generation, g[0].words) == (name.given, name.last, name.generation, name.words)]
        fits = exact if len(fits) > 1 and exact else fits
        if len(fits) == 1:
            fits[0].append(name)
        else:
            groups.append([name])
    return groups


def _nearest(groups: list[list[Name]], distance: Callable[[Name], int]) -> list[list[Name]]:
    """Of several groups, those with the name at the least distance."""
    if len(groups) < 2:
        return groups
    least = [min(map(distance, g)) for g in groups]
    return [g for g, d in zip(groups, least, strict=True) if d == min(least)]


def _apart(a: Name, b: Name) -> int:
    """Typing errors between the words that must be alike in spellings of one: last names, or an organisation's words that aren't cut."""
    if not a.org:
        return edits(a.last, b.last)
    if min(len(a.words), len(b.words)) < 2:
        return 0
    words = enumerate(zip(a.words, b.words, strict=False))
    return sum(edits(x, y) if not _cut(x) and not _cut(y) else 3 * (i == 0 and x != y) for i, (x, y) in words)  # a first word cut short tells less than a misspelt one


def _pairs_alike(a: list[str], b: list[str]) -> Iterator[tuple[str, str]]:
    """Words of a with the words of b that may be spellings of one last name; only pairs with enough letters in common are compared in full."""

    def letters(words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), 32), np.int16)
        for row, word in zip(out, words, strict=True):
            for c in word:
                row[ord(c) & 31] += 1
        return out

    x, y = letters(a), letters(b)
    sizes = y.sum(1)
    for word, row in zip(a, x, strict=True):
        common = np.minimum(row, y).sum(1)
        for i in np.flatnonzero(2 * common >= ALIKE * (row.sum() + sizes)):
            if _same_last(word, b[i]):
                yield word, b[i]


def _head(name: Name) -> str | None:
    """The word that must be alike in all spellings: a last name, an organisation's first word if it stands whole beside others."""
    if not name.org:
        return name.last
    return name.words[0] if len(name.words) > 1 and not _cut(name.words[0]) else None


def compatible_pairs(first: list[Name], second: list[Name] | None = None) -> Iterator[tuple[Name, Name]]:
    """The compatible pairs of one list of names, or of two."""
    sides = []
    for names in (first, first if second is None else second):
        by: dict[str | None, list[tuple[int, Name]]] = defaultdict(list)
        for i, name in enumerate(names):
            by[_head(name)].append((i, name))
        sides.append(by)
    left, right = sides
    heads = [(x, y) for x, y in _pairs_alike([h for h in left if h is not None], [h for h in right if h is not None])]
    heads += [(None, h) for h in right] + [(h, None) for h in left if h is not None and None in right]
    for x, y in heads:
        for i, one in left.get(x, ()):
            for j, two in right[y]:
                if (second is not None or i < j) and compatible(one, two):
                    yield one, two


def names_of(mentions: DataFrame) -> DataFrame:
    """(scope, name, n, org, full): the distinct names of each scope with what is known of them.

    ``mentions`` has (scope, name, kind), kind ORG, PER, PERSON, another or null. A string is an organisation
    if it is tagged so, or holds a word that organisations of several scopes bear, or is a short word of
    capitals. Names begin with a capital, maybe after particles, or with a letter of a script without case;
    a string in small letters is one if it is tagged so and begins with no determiner, or if it has two words
    or more and all of them stand in other names of its scope. Descriptions and strings only tagged as
    something else are no names.
    """
    rows = mentions.where(F.col("scope").isNotNull() & F.col("name").rlike(r"\p{L}"))
    named = rows.groupBy("scope", "name").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.coalesce(F.col("kind") == "ORG", F.lit(False))).alias("tagged"), F.max(F.coalesce(F.col("kind").isin("PER", "PERSON"), F.lit(False))).alias("person"),
        F.max(F.col("kind").isNull() | F.col("kind").isin("ORG", "PER", "PERSON")).alias("named"),
    ).where("named")
    capital = F.col("name").rlike(rf"^\s*(?:(?:{_PARTICLES})\s+|[dlo]['’])*[\p{{Lu}}\p{{Lt}}\p{{Lo}}]")
    told = (F.col("tagged") | F.col("person")) & ~F.col("name").rlike(rf"^\s*(?:{_DETERMINERS})\s")
    named = checkpointed(named.withColumns({"capital": capital, "told": told}))
    every = F.filter(F.split(F.lower("name"), r"[\s,.]+"), lambda w: F.length(w) > 0)
    small = named.where("NOT capital AND NOT told").select("scope", "name", every.alias("words")).where(F.size("words") > 1)
    known_words = named.where("capital").select("scope", F.explode(every).alias("word")).distinct()
    small = small.select("scope", "name", F.size(F.array_distinct("words")).alias("n_words"), F.explode(F.array_distinct("words")).alias("word"))
    borrowed = small.join(known_words, ["scope", "word"]).groupBy("scope", "name").agg(F.first("n_words").alias("n_words"), F.count(F.lit(1)).alias("found")).where("found = n_words")
    named = named.where("capital OR told").unionByName(named.where("NOT capital AND NOT told").join(borrowed.select("scope", "name"), ["scope", "name"], "left_semi"))

    words = F.filter(F.split(F.lower("name"), r"[\s,]+"), lambda w: F.length(w) > 3)
    # Organisations have names of places, which are last names too, after 'the' or 'of': not counted there, and not if persons bear them as often.
    kinds = F.filter(F.split(F.regexp_replace(F.lower("name"), r"^\s*the\s+|\s+of\s.*$", ""), r"[\s,]+"), lambda w: F.length(w) > 3)
    org_words = named.where("tagged <> person").select("scope", "person", F.explode(F.slice(kinds, 2, F.greatest(F.size(kinds), F.lit(1)))).alias("word"))
    scopes = lambda person: F.countDistinct(F.when(F.col("person") == person, F.col("scope")))
    org_words = org_words.groupBy("word").agg(scopes(False).alias("scopes"), scopes(True).alias("of_persons")).where("scopes >= 3 AND scopes > of_persons").select("word")
    borne = named.select("scope", "name", F.explode(words).alias("word")).join(org_words, "word", "left_semi").select("scope", "name").distinct().withColumn("bears", F.lit(True))
    # Titles are no given names, and a short form after one is no middle name.
    given = F.split(F.regexp_replace(F.regexp_replace("name", r",.*", ""), rf"(?i)^\s*(?:(?:{'|'.join(sorted(_TITLES))})\.?\s+)+", ""), r"\s+")
    middle = named.where(~F.col("tagged") & (F.size(given) >= 3)).select("scope", F.explode(F.slice(F.transform(given, F.lower), 2, F.greatest(F.size(given) - 2, F.lit(1)))).alias("word"))
    middle = middle.where("word NOT LIKE '%.' AND length(word) > 2")
    known = middle.groupBy("word").agg(F.countDistinct("scope").alias("scopes")).where("scopes >= 3").select(F.col("word").alias("first"))
    after = F.regexp_extract("name", r",\s*(.*)", 1)
    turned = (after != "") & ~F.lower(F.regexp_replace(after, r"[. ]", "")).isin(*_GENERATIONS)
    first = F.lower(F.try_element_at(F.when(turned, F.split(after, r"\s+")).otherwise(given), F.lit(1)))
    often = named.groupBy(first.alias("first")).agg(F.count(F.lit(1)).alias("often")).join(known.withColumn("known", F.lit(True)), "first", "left")
    out = named.join(borne, ["scope", "name"], "left").withColumn("first", first).join(often, "first", "left")
    org = F.col("tagged") & ~F.col("person") | F.col("bears").isNotNull() | F.col("name").rlike(r"^(?:\p{Lu}{2,5}|(?:\p{Lu}\.){2,5})$")
    return out.select("scope", "name", "n", org.alias("org"), F.col("known").isNotNull().alias("full"), "often")


def learned_short_forms(names: DataFrame, listed: Iterable[str]) -> dict[str, set[str]]:
    """Unlisted short forms of given names with the full ones: with half of the last names, and three at least, that the short one stands with, the full one stands too, five times as often as with all.

    ``names`` is as ``names_of`` gives it. Only names of plain words tell. Middle names of others are no short forms.
    What reaches the driver are pairs of given names.
    """
    words = F.split(F.lower("name"), " ")
    plain = names.where(~F.col("org") & F.col("name").rlike(r"^\p{L}{3,} (?:\S+ )*\p{L}{2,}$"))
    plain = plain.select("scope", words[0].alias("first"), F.element_at(words, -1).alias("last"), "full").where(~F.col("first").isin(*_TITLES) & ~F.col("last").isin(*_GENERATIONS)).distinct()
    small = plain.where("length(first) <= 6 AND NOT full").where(~F.col("first").isin(*listed)).select("scope", "last", F.col("first").alias("short"))
    both = small.join(plain.select("scope", "last", "first"), ["scope", "last"], "left")
    pairs = both.groupBy("short", F.when(F.length("first") > F.length("short"), F.col("first")).alias("first")).agg(F.countDistinct("last").alias("families")).where("families >= 3 AND first IS NOT NULL")
    all_of = small.groupBy("short").agg(F.countDistinct("last").alias("of")).where("of >= 3")
    common = plain.select("scope", "last", "first").distinct().groupBy("first").agg(F.count(F.lit(1)).alias("standing"))
    total = plain.select("scope", "last").distinct().agg(F.count(F.lit(1)).alias("total"))
    out: dict[str, set[str]] = defaultdict(set)
    for row in pairs.join(all_of, "short").where("2 * families >= of").join(common, "first").crossJoin(total).where("families * total >= 5 * of * standing").collect():
        if not alike(fold(row["short"]), fold(row["first"])):
            out[fold(row["short"])].add(fold(row["first"]))
    return out


def link_names(mentions: DataFrame, short_names: DataFrame) -> DataFrame:
    """(scope, entity, name): the names of each scope, those of one person or organisation with one entity name.

    ``mentions`` has (scope, name, kind); ``short_names`` (given_name, short_name), a small fixed table, is
    read by the driver. Strings are taken as stored; null ones, blanks and descriptions are left out;
    repeated rows count as frequency. Other columns are ignored; empty tables give no rows.

    Method: suffix blocking. The suffix of ``SUFFIX`` letters of each token, with the scope, is a block key;
    so are the initials of a person, for words misspelt at their ends. No suffix is discarded: a block is
    refined by the last names (or first words of organisations) in it, of which only those alike by
    longest-common-subsequence ratio are looked at further, by given names, initials, short forms and
    acronyms; a block of over ``BLOCK`` names is compared by pairs of tiles, in tasks of their own. What hangs
    together, distinct names of one scope all, is resolved as one group, where a short form counts only if one
    name alone fits it.
    """
    spark = mentions.sparkSession
    short: dict[str, set] = defaultdict(set)
    for row in short_names.where("given_name IS NOT NULL AND short_name IS NOT NULL").select("given_name", "short_name").distinct().collect():
        short[fold(row["short_name"])].add(fold(row["given_name"]))
    names = checkpointed(names_of(mentions))
    nicks = spark.sparkContext.broadcast({k: frozenset(v) for k, v in (learned_short_forms(names, list(short)) | short).items()})

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for scope, name, n, org, full, often in frame[["scope", "name", "n", "org", "full", "often"]].itertuples(index=False):
                p = parse(name, n, org, nicks.value)
                tokens = p.words if org else [*p.given, p.last]
                keys = {t[-SUFFIX:] for t in tokens if len(t) >= SUFFIX and not t.endswith(".")}
                if org:
                    whole = "".join(w[0] for w in tokens) if len(tokens) > 1 else tokens[0] if tokens else ""
                    keys.add("=" + whole)
                elif p.given and p.last:  # typing errors at the ends of all words leave the initials alone
                    keys.update("#" + first[0] + p.last[0] for first in (p.given[0], *p.nick))
                rows += [(scope, name, n, org, full, often, key) for key in keys or {""}]
            yield pd.DataFrame(rows, columns=["scope", "name", "n", "org", "full", "often", "key"])

    block = ["scope", "org", "key"]
    keyed = names.mapInPandas(index, "scope string, name string, n long, org boolean, full boolean, often long, key string")
    sized = keyed.withColumn("size", F.count(F.lit(1)).over(W.partitionBy(*block))).where("size > 1")
    member = lambda *more: F.collect_list(F.struct("name", "n", "org", "full", "often", *more)).alias("members")
    # Blocks of one tile are grouped where they lie; of the others, each pair of tiles is a group of its own.
    alone = sized.where(F.col("size") <= BLOCK).withColumns({"one": F.lit(0), "two": F.lit(0), "tile": F.lit(0)})
    tiles = F.ceil(F.col("size") / BLOCK).cast("int")
    tiled = sized.where(F.col("size") > BLOCK).withColumn("tile", F.pmod(F.xxhash64("name"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    tiled = tiled.withColumn("one", F.least("tile", "other")).withColumn("two", F.greatest("tile", "other")).repartition(*block, "one", "two")
    blocks = [rows.groupBy(*block, "one", "two").agg(member("tile")).select("scope", "one", "two", "members") for rows in (alone, tiled)]

    def parsed(members) -> list[Name]:
        out = [parse(m["name"], m["n"], m["org"], nicks.value, often=m["often"]) for m in members]
        for name, m in zip(out, members, strict=True):
            name.independent = bool(name.given) and m["full"]
        return out

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for scope, one, two, members in zip(frame["scope"], frame["one"], frame["two"], frame["members"], strict=True):
                side = lambda t, ms=members: parsed([m for m in ms if m["tile"] == t])
                rows += [(scope, x.text, y.text) for x, y in compatible_pairs(side(one), None if one == two else side(two))]
            yield pd.DataFrame(rows, columns=["scope", "a", "b"])

    pairs = blocks[0].unionByName(blocks[1]).mapInPandas(compare, "scope string, a string, b string")
    edges = pairs.select(F.xxhash64("scope", "a").alias("a"), F.xxhash64("scope", "b").alias("b")).distinct()
    labels = connected(edges)

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for scope, members in zip(frame["scope"], frame["members"], strict=True):
                rows += [(scope, min(x.text for x in group), name.text) for group in resolve(parsed(members)) for name in group]
            yield pd.DataFrame(rows, columns=["scope", "entity", "name"])

    labelled = names.withColumn("node", F.xxhash64("scope", "name")).join(labels, "node", "left")
    groups = labelled.where("label IS NOT NULL").groupBy("scope", "label").agg(member())
    linked = groups.mapInPandas(settle, "scope string, entity string, name string")
    return linked.unionByName(labelled.where("label IS NULL").select("scope", F.col("name").alias("entity"), "name"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): connected components of edges (a, b) of BIGINT nodes, by least label; each round also follows labels of labels.

    Nodes are hashes. Should two share one, their components come out as one, which is harmless where a
    component is only a group to look at.
    """
    both = checkpointed(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        of = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = checkpointed(step.join(of, "label").select("node", "was", F.least("label", "further").alias("label")))
        labels = new.select("node", "label")
        if not new.where("was <> label").limit(1).count():
            return labels


def linked_pairs(linked: DataFrame) -> DataFrame:
    """(scope, name_a, name_b), name_a < name_b, of the names of one entity."""
    a, b = linked.alias("a"), linked.alias("b")
    same = (F.col("a.scope") == F.col("b.scope")) & (F.col("a.entity") == F.col("b.entity")) & (F.col("a.name") < F.col("b.name"))
    return a.join(b, same).select("a.scope", F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"))
