"""Column functions over strings, name lists and prompts: built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that cleaning drops (fixed values).
STOP_WORDS = ("the", "of", "a", "an", "how", "what", "which", "why", "where", "who", "we", "are", "is", "by", "base", "on", "in")
#: The 32 ASCII punctuation characters (fixed value).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPACES = r"[ \t\n\x0B\f\r]+"


def tokens(text: Column) -> Column:
    """Words between white space; none for null, empty or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACES), lambda x: x != "")


def clean_text(text: Column) -> Column:
    """Punctuation deleted without a space in its place, lower case, stop words dropped, single spaces; null is empty."""
    plain = F.lower(F.translate(F.coalesce(text, F.lit("")), PUNCTUATION, ""))
    return F.array_join(F.filter(tokens(plain), lambda x: ~x.isin(*STOP_WORDS)), " ")


def filled_lower(text: Column, default: str = "") -> Column:
    return F.lower(F.coalesce(text, F.lit(default)))


def composed_text(title: Column, abstract: Column, keywords: Column) -> Column:
    """The cleaned text of title, cleaned abstract and keyword list."""
    return clean_text(F.concat_ws(" ", filled_lower(title), clean_text(abstract), F.lower(F.array_join(F.coalesce(keywords, F.array().cast("array<string>")), " "))))


def field_at(people: Column, position: int, field: str = "name") -> Column:
    """Lower-cased field of the element at a position (from 0); empty where there is none."""
    return F.lower(F.coalesce(F.get(people, position)[field], F.lit("")))


def field_list(people: Column, field: str = "name") -> Column:
    """Lower-cased, non-empty values of a field."""
    return F.filter(F.transform(people, lambda p: F.lower(p[field])), lambda x: x.isNotNull() & (x != ""))


def composite_key(*columns: Column) -> Column:
    return F.concat_ws("_", *columns)


def name_forms(name: Column) -> Column:
    """The lower-cased name; of two words, both orders."""
    trimmed = F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", ""))
    words = tokens(trimmed)
    first, second = F.get(words, 0), F.get(words, 1)
    return F.when(F.size(words) == 2, F.array(F.concat_ws(" ", first, second), F.concat_ws(" ", second, first))).otherwise(F.array(trimmed))


def name_matches(name: Column, others: Column) -> Column:
    """1 if some of the other names is the name, its words in either order; else 0."""
    return F.exists(others, lambda o: F.arrays_overlap(name_forms(o), name_forms(name))).cast("int")


def shares_token(name: Column, others: Column) -> Column:
    """1 if some of the other names has a lower-cased word in common."""
    own = tokens(F.lower(name))
    return F.exists(others, lambda o: F.size(F.array_intersect(tokens(F.lower(o)), own)) > 0).cast("int")


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda x: x != "")


def _counts_in(letters: Column, c: Column) -> Column:
    return F.size(F.filter(letters, lambda x: x == c))


def matching_pairs(a: Column, b: Column) -> Column:
    """Pairs of equal characters of two strings: over characters, the product of their counts."""
    x, y = _letters(a), _letters(b)
    return F.aggregate(F.array_distinct(x), F.lit(0), lambda s, c: s + _counts_in(x, c) * _counts_in(y, c))


def common_characters(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two strings' characters."""
    x, y = _letters(a), _letters(b)
    return F.aggregate(F.array_distinct(x), F.lit(0), lambda s, c: s + F.least(_counts_in(x, c), _counts_in(y, c)))


def total_common_lengths(name: Column, others: Column) -> Column:
    """struct(pairs, characters, most): sums over the other names, and the largest of either value for one of them."""
    plain = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit(""))
    each = F.transform(others, lambda o: F.struct(matching_pairs(plain(name), plain(o)).alias("p"), common_characters(plain(name), plain(o)).alias("c")))
    total = lambda f: F.aggregate(each, F.lit(0), lambda s, e: s + e[f])
    most = F.aggregate(each, F.lit(0), lambda s, e: F.greatest(s, e["p"], e["c"]))
    return F.struct(total("p").alias("pairs"), total("c").alias("characters"), most.alias("most"))


def other_names(name: Column, others: Column) -> Column:
    return F.filter(others, lambda o: F.lower(o) != F.lower(name))


def set_distance(a: Column, b: Column, kind: str = "jaccard") -> Column:
    """Distance of two word sets: 1 - |a & b| / |a | b|, or (sorensen) 1 - 2 |a & b| / (|a| + |b|); 0 if either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    common = F.size(F.array_intersect(x, y))
    whole = F.size(F.array_union(x, y)) if kind == "jaccard" else (F.size(x) + F.size(y)) / 2
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(1 - common / whole)


def clip_words(text: Column, n_tokens: Column, most: int = 200, keep: int = 100) -> Column:
    """The first `keep` space-separated words of texts of `most` tokens or more; others whole."""
    return F.when(n_tokens >= most, F.array_join(F.slice(F.split(text, " "), 1, keep), " ")).otherwise(text)


def prompt(titles: Column, target: Column, template: str) -> Column:
    """The template with {titles} (joined by ' # ') and {target} filled in."""
    out = F.lit(template)
    for name, value in (("{titles}", F.array_join(titles, " # ")), ("{target}", target)):
        out = F.replace(out, F.lit(name), F.coalesce(value, F.lit("")))
    return out


def yes_share(yes: Column, no: Column) -> Column:
    """yes / (yes + no); null where the sum is 0."""
    return F.try_divide(yes, yes + no)


def masked_labels(ids: Column, mask: Column, ignore: int = -100) -> Column:
    return F.zip_with(mask, ids, lambda m, i: F.when(m == 1, i).otherwise(F.lit(ignore)))


def padded(ids: Column, length: Column, value: int, left: bool = False) -> Column:
    fill = F.array_repeat(F.lit(value), F.greatest(length - F.size(ids), F.lit(0)).cast("int"))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def assembled(parts: list[Column], most: int) -> Column:
    """Concatenated id lists, cut after `most` ids."""
    return F.slice(reduce(lambda a, b: F.concat(a, b), parts), 1, most)


def budgeted_spans(spans: Column, budget: int) -> Column:
    """Each span of an array<array<T>> cut to what is left of the budget, empty ones kept."""
    def step(state, span):
        left = F.greatest(F.lit(budget) - state["used"], F.lit(0))
        taken = F.slice(span, 1, left)
        return F.struct((state["used"] + F.size(taken)).alias("used"), F.concat(state["out"], F.array(taken)).alias("out"))

    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<array<int>>").alias("out"))
    return F.aggregate(spans, start, step, lambda s: s["out"])
