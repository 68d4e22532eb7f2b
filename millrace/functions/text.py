"""Part numbers, brands and categories in text: plain column expressions, no Python on the executors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.dictionaries import JUNK_NUMBERS, NO_BRANDS

#: Characters that readers of worn labels confuse, and what they count as.
CONFUSED = ("OILSB", "01158")
#: Shapes of part numbers; the first with any match wins.
NUMBER_SHAPES = (r"\b[A-Z]{2,4}\d{2,5}[A-Z]?\b", r"\b[A-Z]{1,4}\d{2,4}[/-]\d{1,4}\b", r"\b\d{4,6}[A-Z]{1,4}\b")
#: Shapes of the codes that a combined name holds.
CODE_SHAPES = r"\d{5}-[A-Z0-9]{3}-[A-Z0-9]{2,3}|\d{5}-\d{5}(?:-\d{2})?(?=-|$)|IP-\d{2}-\d{4}[A-Z]*"

#: The same for numbers made from keys, which have five digits or more.
LONG_CODE_SHAPES = CODE_SHAPES.replace(r"\d{5}-[A-Z0-9]{3}-", r"\d{5,}-[A-Z0-9]{3}-")


def _or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def stripped(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_or_empty(x), r"(?U)^\s+|\s+$", "")


def part_number(raw: Column) -> Column:
    """Upper case without white space, hyphens and slashes; null gives ''."""
    return F.regexp_replace(F.upper(_or_empty(raw)), r"(?U)[\s\-/]+", "")


def part_number_or_null(raw: Column) -> Column:
    """The part number of what was found; null if nothing was."""
    return F.when(raw.isNotNull(), part_number(raw))


def match_key(raw: Column) -> Column:
    """The part number with confusable characters made one."""
    return F.translate(part_number(raw), *CONFUSED)


def equivalent(a: Column, b: Column) -> Column:
    return match_key(a) == match_key(b)


def manufacturer_number(raw: Column) -> Column:
    """The first of several numbers in a field, letters and digits only; '' for junk and for fewer than three."""
    first = F.element_at(F.split(_or_empty(raw), r"[,;/|]| or ", 2), 1)
    norm = F.regexp_replace(F.upper(first), "[^A-Z0-9]", "")
    return F.when(norm.isin(JUNK_NUMBERS) | (F.length(norm) < 3), "").otherwise(norm)


def brand_name(raw: Column) -> Column:
    """Trimmed, lower case, single spaces; '' for what stands for no brand."""
    b = F.regexp_replace(F.lower(stripped(raw)), r"(?U)\s+", " ")
    return F.when(b.isin(NO_BRANDS), "").otherwise(b)


def letters_digits(raw: Column) -> Column:
    return F.regexp_replace(F.lower(_or_empty(raw)), "[^a-z0-9]", "")


def long_numbers(text: Column, least: int = 7) -> Column:
    """Distinct tokens with a digit and at least `least` letters and digits."""
    tokens = F.regexp_extract_all(_or_empty(text), F.lit(r"([A-Za-z0-9][A-Za-z0-9-]*[A-Za-z0-9])"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(tokens, letters_digits), lambda t: (F.length(t) >= least) & t.rlike("[0-9]")))


def longest(matches: Column) -> Column:
    """The longest of an array of strings, the first of several; null if there is none."""
    best = F.aggregate(matches, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.nullif(best, F.lit(""))


def find_part_number(text: Column) -> Column:
    upper = F.upper(_or_empty(text))
    return F.coalesce(*[longest(F.regexp_extract_all(upper, F.lit(f"({p})"), F.lit(1))) for p in NUMBER_SHAPES])


def _any_place(words: list[str]) -> str:
    """A regex that at each place of a text captures the first of the words, in their order, that begins there. Words are
    grouped by their first letter, so at most places one look is enough."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(re.escape(w[1:]))
    return "(?=(" + "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in by.items()) + "))"


def _earliest(low: Column, words: list[str]) -> Column:
    """Which of the words, counted from 1, is the first in their order that the text has anywhere; null for none.

    One scan of the text: where the earliest word stands, no word before it in order can begin, so it is what is captured.
    """
    found = F.array_distinct(F.regexp_extract_all(low, F.lit(_any_place(words)), F.lit(1)))
    order = F.array(*[F.lit(w) for w in words])
    return F.array_min(F.transform(found, lambda w: F.array_position(order, w)))


def _needed(entries: dict[str, list[str]]) -> list[tuple[str, str]]:
    """Aliases with their entries, in order, but for those that hold an earlier one: where they are, that is."""
    out: list[tuple[str, str]] = []
    for name, aliases in entries.items():
        out += [(a, name) for a in aliases if a and not any(b in a for b, _ in out) and not any(b in a for b in aliases[: aliases.index(a)] if b)]
    return out


def first_entry(text: Column, entries: dict[str, list[str]], long: bool = False) -> Column:
    """Name of the first entry that has an alias in the lower-case text. `long` texts are searched for one alias after the
    other, which is quicker than a look at each place; the answer is the same."""
    pairs = _needed(entries)
    if not pairs:
        return F.lit(None).cast("string")
    low = F.lower(_or_empty(text))
    if long:
        return F.coalesce(*[F.when(F.contains(low, F.lit(a)), F.lit(name)) for a, name in pairs])
    return F.get(F.array(*[F.lit(name) for _, name in pairs]), _earliest(low, [a for a, _ in pairs]).cast("int") - 1)


def any_of(text: Column, words: list[str]) -> Column:
    """Whether the lower-case text has any of the words in it."""
    return F.lower(_or_empty(text)).rlike("|".join(r"\Q" + w + r"\E" for w in words)) if words else F.lit(False)


def first_of(text: Column, words: list[str]) -> Column:
    """The first of the words, in their order, that the lower-case text has in it."""
    return first_entry(text, {w: [w] for w in words})


def brand_with_confidence(text: Column, entries: dict[str, list[str]]) -> Column:
    """``struct(brand, confidence)``: the first alias found counts by its share of the text; null and 0 without one."""
    low = F.lower(_or_empty(text))
    pairs = _needed(entries)
    hits = F.array(*[F.struct(F.lit(name).alias("brand"), F.lit(float(len(a))).alias("long")) for a, name in pairs])
    hit = F.get(hits, _earliest(low, [a for a, _ in pairs]).cast("int") - 1)
    share = F.when(hit["long"].isNotNull(), F.least(F.lit(1.0), hit["long"] / F.greatest(F.length(low), F.lit(1))))
    return F.struct(hit["brand"].alias("brand"), F.coalesce(share, F.lit(0.0)).alias("confidence"))


def class_category(name: Column, entries: dict[str, list[str]]) -> Column:
    return F.coalesce(first_entry(name, entries), F.lit("unknown"))


def slug(raw: Column) -> Column:
    return F.upper(F.btrim(F.regexp_replace(_or_empty(raw), "[^A-Za-z0-9]+", "-"), F.lit("-")))


def file_safe(raw: Column) -> Column:
    return F.regexp_replace(F.replace(_or_empty(raw), F.lit("::"), F.lit("__")), "[^A-Za-z0-9._-]+", "_")


def split_codes(name: Column, shapes: str = CODE_SHAPES) -> Column:
    """Codes of a combined name, left to right; what has none of the `shapes` ends at the next hyphen."""
    found = F.regexp_extract_all(_or_empty(name), F.lit(rf"({shapes}|[^-]*)(?:.|$)"), F.lit(1))
    return F.filter(found, lambda c: c != "")


def needs_check(codes: Column) -> Column:
    return (F.size(F.array_distinct(codes)) < F.size(codes)) | F.exists(codes, lambda c: F.length(c) < 6)


def flag(raw: Column) -> Column:
    """true/1/yes and false/0/no/empty, any case; anything else gives null."""
    v = F.lower(stripped(raw))
    return F.when(v.isin("true", "1", "yes"), True).when(v.isin("false", "0", "no", ""), False)


def class_name(raw: Column) -> Column:
    return F.translate(stripped(F.lower(_or_empty(raw))), " -", "__")


def detector_class(raw: Column, aliases: dict[str, str | None]) -> Column:
    """The class that a spelling stands for; null for those that stand for none."""
    name = class_name(raw)
    none = [a for a, c in aliases.items() if c is None]
    return F.when(~name.isin(none), F.coalesce(*[F.when(name == a, F.lit(c)) for a, c in aliases.items() if c is not None], name))


def seller_hash(name: Column, digits: int = 12) -> Column:
    return F.substring(F.sha1(F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown"))), 1, digits)


def first_aspect(aspects: Column, keys: list[str]) -> Column:
    """The first non-empty value of a map under one of `keys`, in their order."""
    return F.coalesce(*[F.nullif(F.try_element_at(aspects, F.lit(k)), F.lit("")) for k in keys], F.lit(""))


def leaf_label(path: Column, labels: dict[str, str]) -> Column:
    leaf = F.element_at(F.split(_or_empty(path), r"\|"), -1)
    return F.coalesce(*[F.when(leaf == k, F.lit(v)) for k, v in labels.items()])


def url_base(url: Column) -> Column:
    return F.element_at(F.split(url, r"\?"), 1)


def clean_note(note: Column) -> Column:
    return F.btrim(_or_empty(note), F.lit(" |"))


def index_text(name: Column, description: Column) -> Column:
    """Name and description in one; a missing description adds nothing."""
    return stripped(F.concat(_or_empty(name), F.lit(" "), _or_empty(description)))


#: What a title says that offers parts of both axles, and what else speaks of more than one number.
BOTH_AXLES = r"front\s*[+&/]\s*rear|rear\s*[+&/]\s*front"
SEVERAL = r"\bkit\b|\blot\b|\bbulk\b|\bassorted\b"


def joint_title(title: Column, lighting: Column, own: Column | None = None) -> Column:
    """Titles that suggest more than one part number; for lighting only those of both axles. A title that has the part's
    `own` number (letters and digits, lower case) in it is about that."""
    joint = F.when(lighting, title.rlike(f"(?i){BOTH_AXLES}")).otherwise(title.rlike(f"(?i){BOTH_AXLES}|{SEVERAL}"))
    return joint if own is None else joint & ~F.contains(letters_digits(title), own)


def title_tokens(title: Column) -> Column:
    """Tokens of four characters or more that a number can be, as letters and digits, in their order."""
    return F.transform(F.regexp_extract_all(_or_empty(title), F.lit(r"([A-Za-z0-9][A-Za-z0-9-]{2,}[A-Za-z0-9])"), F.lit(1)), letters_digits)


def seller_codes(raw: Column) -> Column:
    """Codes of a seller's own list of part numbers: six letters and digits or more, one a digit at least."""
    pieces = F.transform(F.split(_or_empty(raw), "[,;/]"), letters_digits)
    return F.array_distinct(F.filter(pieces, lambda c: (F.length(c) >= 6) & c.rlike("[0-9]")))


def short_number(raw: Column) -> Column:
    return (F.length(letters_digits(raw)) <= 4).cast("int")


def junk_number(own: Column) -> Column:
    """Numbers without a digit, of under four characters, or that begin like a note."""
    return ~own.rlike("[0-9]") | F.startswith(own, F.lit("update")) | (F.length(own) < 4)
