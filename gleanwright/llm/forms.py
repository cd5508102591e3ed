"""One written form for texts that a reader cannot tell apart.

Look-alike members (code points and short strings) are joined into classes by
union-find, so equivalence is transitive.  A class is written as its most
frequent member in the corpus at hand; a text is rewritten leftmost-longest by
one Aho-Corasick automaton over all members, between canonical decomposition
and canonical composition.

What does not show: width, composition of accents, ligatures, invisible
characters, the kind of a blank or of a line break, blanks at either end, and
letters of another script with the same shape.  Case, punctuation, digits,
accents and the number of blanks do show.  Null gives null; an empty or
all-blank text gives the empty text.  A zero-width joiner inside an emoji
sequence does show, since it makes another picture, and stays.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwright.session import checkpointed

# Letters of other scripts that have the shape of a Latin or Greek letter:
# single letters of Greek, Cyrillic, Armenian, Cherokee, Coptic and Lisu that the public
# Unicode confusables join, less those that only resemble each other (α and a, У and Y).
SAME_SHAPE = {
    "A": "ΑАᎪꓮ", "B": "ΒВᏴꓐ", "C": "СϹᏟⲤꓚ", "D": "Ꭰꓓ", "E": "ΕЕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "ΗНᎻⲎꓧ",
    "I": "ΙІӀⲒꓲ", "J": "ЈͿᎫꓙ", "K": "ΚКᏦⲔꓗ", "L": "ᏞⳐꓡ", "M": "ΜМᎷϺⲘꓟ", "N": "ΝⲚꓠ", "O": "ΟОՕⲞꓳ",
    "P": "ΡРᏢⲢꓑ", "Q": "Ԛ", "R": "ᎡᏒꓣ", "S": "ЅՏᏚᏕꓢ", "T": "ΤТᎢⲦꓔ", "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳᏔꓪ",
    "X": "ΧХⲬꓫ", "Y": "ΥҮⲨꓬ", "Z": "ΖᏃꓜ",
    "a": "а", "c": "сϲⲥꮯ", "d": "ԁ", "e": "е", "g": "ցɡ", "h": "һհ", "i": "іꭵ", "j": "јϳ", "l": "ӏ",
    "n": "ո", "o": "οоօⲟ", "p": "ρрⲣ", "q": "ԛզ", "s": "ѕꮪ", "u": "ս", "v": "νѵꮩ", "w": "ԝꮃ",
    "x": "х", "y": "уү", "z": "ꮓ",
    "Æ": "Ӕ", "æ": "ӕ", "Ə": "Ә", "ə": "ә", "Ɵ": "Ө", "ɵ": "ө", "Þ": "Ϸ", "þ": "ϸ", "Ɔ": "Ͻꓛ", "Ǝ": "ꓱ", "Ɛ": "Ԑ", "ɛ": "ԑ", "ĸ": "кⲕ",
    "ᴀ": "ꭺ", "ʙ": "в", "ᴅ": "ꭰ", "ᴇ": "ꭼ", "ʜ": "нꮋ", "ᴊ": "ꭻ", "ʟ": "ꮮ", "ᴍ": "мꮇ", "ᴘ": "ꮲ", "ʀ": "ꭱ", "ᴛ": "тꭲ",
    "Γ": "ГⲄ", "Δ": "Ⲇ", "Λ": "Ʌꓥ", "Π": "ПⲠ", "Σ": "Ʃ", "Φ": "ФⲪ", "Ψ": "ѰⲮ", "ω": "ⲱ", "И": "Ͷ", "Є": "Ⲉ", "є": "ⲉ",
}
# Line breaks other than the line feed; a pair counts as one.
LINE_BREAKS = ("\r\n", "\r", "\x0b", "\x0c", "\x85", "\u2028", "\u2029")
# Format characters that do leave a mark.
VISIBLE_FORMAT = frozenset("\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd")
# Default-ignorable characters outside the format category.
OTHER_INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
SHAPE_TAGS = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")
_KEPT_JOINER = "\ufdd0"  # a noncharacter
_EMOJI_JOIN = re.compile("(?<=[←-⯿\ufe0f\U0001f000-\U0001faff])\u200d(?=[←-⯿\U0001f000-\U0001faff])")


class UnionFind:
    """Disjoint sets of strings; the root is the least member in code-point order."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in sorted(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return out


def _invisible(c: str) -> bool:
    kind = unicodedata.category(c)
    return (
        (kind == "Cf" and c not in VISIBLE_FORMAT)
        or (kind == "Cc" and c not in "\t\n" and c not in LINE_BREAKS)
        or c in OTHER_INVISIBLE
        or "\ufe00" <= c <= "\ufe0f"
        or "\U000e0100" <= c <= "\U000e01ef"
    )


def equivalences() -> Iterator[tuple[str, str]]:
    """Pairs that look the same, from character data by rule and from the fixed table."""
    yield from ((x, "\n") for x in LINE_BREAKS)
    yield "\t", " "
    yield from ((y, latin) for latin, others in SAME_SHAPE.items() for y in others)
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if _invisible(c):
            yield c, ""
        elif kind == "Zs":
            yield c, " "
        else:
            tag, _, rest = unicodedata.decomposition(c).partition(" ")
            if not tag.startswith("<"):
                continue
            parts = "".join(chr(int(x, 16)) for x in rest.split())
            letters = all(unicodedata.category(x)[0] in "LM" for x in parts)
            if tag in SHAPE_TAGS and not parts.startswith(" "):
                yield c, unicodedata.normalize("NFD", parts)
            elif tag == "<compat>" and len(parts) > 1 and kind[0] == "L" and letters:
                yield c, unicodedata.normalize("NFD", parts)  # ligatures and digraphs
            elif tag == "<noBreak>" or (tag == "<compat>" and len(parts) == 1 and (kind == "Nl" or c == "µ")):
                yield c, parts  # unbreakable hyphens, number letters of one letter, the micro sign


@lru_cache(maxsize=1)
def look_alike_classes() -> tuple[tuple[str, ...], ...]:
    sets = UnionFind()
    for a, b in equivalences():
        sets.union(a, b)
    return tuple(tuple(x) for x in sets.classes().values())


@lru_cache(maxsize=1)
def members() -> frozenset[str]:
    return frozenset(x for c in look_alike_classes() for x in c if x)


@lru_cache(maxsize=1)
def decomposing() -> tuple[str, ...]:
    """Code points with a canonical decomposition, syllables apart (their parts never change)."""
    return tuple(c for c in map(chr, range(sys.maxunicode + 1)) if (d := unicodedata.decomposition(c)) and d[0] != "<")


def _automaton(patterns: dict[str, str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for pattern, value in patterns.items():
        found.add_word(pattern, (len(pattern), value))
    found.make_automaton()
    return found


def _decomposed(text: str) -> str:
    if "\u200d" in text:
        text = _EMOJI_JOIN.sub(_KEPT_JOINER, text)
    return unicodedata.normalize("NFD", text)


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """What each member is written as: the most frequent code point of its class,
    ties to the least; a string (ligature parts) is written code point by code point."""
    single: dict[str, str] = {}
    strings: list[tuple[str, ...]] = []
    for group in look_alike_classes():
        if "" in group:
            single.update(dict.fromkeys(group, ""))
            continue
        longest = max(group, key=lambda x: (len(x), x))
        if len(longest) > 1 and "\n" not in group:
            strings.append(group)
        else:
            ones = [x for x in group if len(x) == 1]
            best = min(ones, key=lambda x: (-counts.get(x, 0), x))
            single.update(dict.fromkeys(group, best))
    for group in strings:
        longest = max(group, key=lambda x: (len(x), x))
        written = "".join(single.get(x, x) for x in longest)
        single.update(dict.fromkeys(group, written))
    return {k: v for k, v in single.items() if k and k != v}


class Rewriter:
    """Rewrites texts; built once per worker from the (bounded) representative table."""

    def __init__(self, written: dict[str, str]) -> None:
        self.automaton = _automaton(written)
        changing = {x[0] for x in written}
        changing.update(c for c in decomposing() if any(x in changing for x in unicodedata.normalize("NFD", c)))
        self.changing = frozenset(changing)
        ascii_ = "".join(sorted(x for x in changing if x.isascii()))
        self.ascii = re.compile(f"[{re.escape(ascii_)}]" if ascii_ else "(?!)")

    def unchanged(self, text: str) -> bool:
        if text.isascii():
            return not self.ascii.search(text)
        return self.changing.isdisjoint(text) and unicodedata.is_normalized("NFC", text)

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        if self.unchanged(text):
            return text.strip(" \n")
        source, out, at = _decomposed(text), [], 0
        for end, (n, value) in self.automaton.iter_long(source):
            start = end - n + 1
            out.append(source[at:start])
            out.append(value)
            at = end + 1
        out.append(source[at:])
        form = unicodedata.normalize("NFC", "".join(out)).replace(_KEPT_JOINER, "\u200d")
        return form.strip(" \n")


@lru_cache(maxsize=8)
def _cached(written: tuple[tuple[str, str], ...]) -> Rewriter:
    return Rewriter(dict(written))


def rewriter(written: dict[str, str]) -> Rewriter:
    return _cached(tuple(sorted(written.items())))


def member_counts(texts: DataFrame) -> DataFrame:
    """(member, n) over a one-column table of texts; combined per task before the shuffle."""
    name = texts.columns[0]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, plain = _automaton(dict.fromkeys(members(), "")), {}
        letters = [x for x in members() if len(x) == 1 and x.isascii()]
        found: dict[str, int] = {}
        for batch in batches:
            texts = [t for t in batch[name] if isinstance(t, str)]
            together = "".join(t for t in texts if t.isascii())
            for x in letters:
                plain[x] = plain.get(x, 0) + together.count(x)
            for text in texts:
                if text.isascii():
                    continue
                source = _decomposed(text)
                for end, (n, _) in automaton.iter_long(source):
                    x = source[end - n + 1 : end + 1]
                    found[x] = found.get(x, 0) + 1
                    if n > 1:  # the parts are there as well
                        for y in x:
                            found[y] = found.get(y, 0) + 1
        for x, n in plain.items():
            if n:
                found[x] = found.get(x, 0) + n
        if found:
            yield pd.DataFrame({"member": list(found), "n": list(found.values())}, columns=["member", "n"])

    counted = texts.mapInPandas(count, "member string, n bigint")
    return counted.groupBy("member").agg(F.sum("n").alias("n"))


def fit_forms(texts: DataFrame) -> dict[str, str]:
    """Representative table of a corpus (one column of texts).  What reaches the driver
    is one row for each look-alike member that occurs, a fixed number of a few thousand."""
    return representatives({r.member: r.n for r in member_counts(texts).collect()})


def form(text: Column, written: dict[str, str]) -> Column:
    """The text in its one form."""

    @F.pandas_udf("string")
    def rewrite(batch: pd.Series) -> pd.Series:
        one = rewriter(written)
        return pd.Series([one(x) if isinstance(x, str) else None for x in batch], dtype=object)

    return rewrite(text)


def spelled(records: DataFrame, written: dict[str, str]) -> DataFrame:
    """(id, key, spelling), distinct: digests of each text's form and of the text itself.
    Forms are made once and kept, since what follows reads them several times."""
    digest = lambda c: F.unhex(F.md5(F.encode(c, "UTF-8")))
    return checkpointed(records.where(F.col("text").isNotNull()).select("id", digest(form(F.col("text"), written)).alias("key"), digest(F.col("text")).alias("spelling")).distinct())


def look_alike_pairs(records: DataFrame, written: dict[str, str], rows_per_salt: int = 4096) -> DataFrame:
    """(id_a, id_b): records (id, text) with different ids whose texts look the same and are
    not the same characters.  Null texts take no part, repeated rows count once.

    The distinct spellings of a class are paired, copies are not; each pair of spellings is
    then expanded into its ids, so that the work follows the rows that come out.  A spelling
    of many ids and a class of many spellings are salted into parts of ``rows_per_salt``."""
    every_form = spelled(records, written)
    several = every_form.groupBy("key").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).where("lo <> hi").select("key")
    keyed = every_form.join(several, "key", "left_semi")
    part = lambda c, n: F.expr(f"int(pmod(xxhash64({c}), {n}))")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    salts = lambda n: F.ceil(n / rows_per_salt).cast("int")
    sizes = keyed.groupBy("key", "spelling").agg(F.count("*").alias("n"))
    classes = sizes.groupBy("key").agg(salts(F.count("*")).alias("splits"))
    among = sizes.join(classes, "key").select("key", "spelling", salts(F.col("n")).alias("salts"), "splits")
    one = among.select("key", F.col("spelling").alias("spelling_a"), F.col("salts").alias("salts_a"), part("spelling", "splits").alias("split"))
    two = among.select("key", F.col("spelling").alias("spelling_b"), F.col("salts").alias("salts_b"), every("splits").alias("split"))
    both = one.join(two, ["key", "split"]).where("spelling_a < spelling_b").select("spelling_a", "spelling_b", every("salts_a").alias("salt_a"), "salts_b")
    both = both.select("spelling_a", "spelling_b", "salt_a", every("salts_b").alias("salt_b"))
    # A spelling has one form, so it alone finds its ids.
    ids = keyed.join(among.select("spelling", "salts"), "spelling").select("spelling", "id", part("id", "salts").alias("salt"))
    side = lambda x: ids.select(F.col("spelling").alias(f"spelling_{x}"), F.col("salt").alias(f"salt_{x}"), F.col("id").alias(f"from_{x}"))
    pairs = both.join(side("a"), ["spelling_a", "salt_a"]).join(side("b"), ["spelling_b", "salt_b"]).where("from_a <> from_b")
    return pairs.select(F.least("from_a", "from_b").alias("id_a"), F.greatest("from_a", "from_b").alias("id_b")).distinct()


def look_alike_classes_of(records: DataFrame, written: dict[str, str]) -> DataFrame:
    """(id, class_id, spellings, links): one row per id and form; ``links`` counts the ids of
    the class.  Every id of the class is kept, copies are not expanded into pairs."""
    keyed = spelled(records, written).withColumnRenamed("key", "class_id")
    sizes = keyed.groupBy("class_id", "spelling").agg(F.count("*").alias("n")).groupBy("class_id").agg(
        F.count("*").alias("spellings"), F.sum("n").alias("links")
    )
    return keyed.select("id", "class_id").distinct().join(sizes, "class_id").select("id", F.lower(F.hex("class_id")).alias("class_id"), "spellings", "links")
