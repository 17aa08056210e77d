"""Model answers and cells that hold JSON: fences, lists, picks, probabilities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys under which answers give their choice, and the inner keys of nested ones.
PICK_KEYS = ("prediction", "pick", "answer", "label", "predicted_class", "class", "choice", "decision", "selected_hypothesis", "hypothesis", "final_answer")
INNER_KEYS = ("class", "value", "label", "name", "text")


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once: an expression that f names several times, or in a lambda of its own, is else worked out each time."""
    return F.transform(F.array(x), f)[0]


def field(body: Column, path: str) -> Column:
    """get_json_object of $.path, without a parse (and its exception) where the path's first name can't be in the body; escapes may spell any name."""
    return F.when(F.contains(body, F.lit(path.split(".")[0])) | F.contains(body, F.lit("\\")), F.get_json_object(body, f"$.{path}"))


def unfenced(content: Column) -> Column:
    """Without the lines that fence a block of code."""
    return once(content, lambda c: F.trim(F.when(F.contains(c, F.lit("```")), F.regexp_replace(c, r"(?m)^\s*```.*$", "")).otherwise(c)))


def cell_list(cell: Column) -> Column:
    """A list in a table cell, quoted either way; one value alone is a list of it; null and '' an empty list."""
    parsed = F.from_json(F.replace(cell, F.lit("'"), F.lit('"')), "array<string>")
    return F.when(cell.isNull() | (F.trim(cell) == ""), F.array().cast("array<string>")).when(F.trim(cell).startswith("["), F.coalesce(parsed, F.array().cast("array<string>"))).otherwise(F.array(F.trim(cell)))


def match(raw: Column, hypotheses: Column) -> Column:
    """A hypothesis that a string names: exactly, in any case, without spaces, as the only prefix, or as the only longest part."""
    bare = lambda h: F.replace(F.lower(h), F.lit(" "), F.lit(""))
    at = lambda a, i: F.try_element_at(a, F.lit(i))
    only = lambda a: once(a, lambda x: F.when(F.size(x) == 1, at(x, 1)))

    def longest(parts: Column) -> Column:
        return once(F.array_max(F.transform(parts, F.length)), lambda n: only(F.filter(parts, lambda h: F.length(h) == n)))

    def loosely(low: Column) -> Column:
        same = F.filter(hypotheses, lambda h: F.lower(h) == low)
        tight = F.filter(hypotheses, lambda h: bare(h) == low)
        front = F.filter(hypotheses, lambda h: F.startswith(low, F.lower(h)) | F.startswith(low, bare(h)))
        parts = F.filter(hypotheses, lambda h: F.contains(low, F.lower(h)))
        return F.coalesce(at(same, -1), at(tight, -1), only(front), once(parts, longest))

    s = F.regexp_replace(F.trim(raw), "^[\"'.,;:!?()\\[\\]{}*`]+|[\"'.,;:!?()\\[\\]{}*`]+$", "")
    return once(s, lambda s: F.coalesce(at(F.filter(hypotheses, lambda h: h == s), 1), once(F.lower(s), loosely)))


def pick(content: Column, hypotheses: Column) -> Column:
    """The first string that names a hypothesis, in order of the keys: texts, members of lists, inner keys of objects; null where none does, never a default."""
    first = lambda a: F.try_element_at(F.filter(F.transform(a, lambda c: match(c, hypotheses)), lambda h: h.isNotNull()), F.lit(1))

    def chosen(body: Column, k: str) -> Column:
        inner = F.coalesce(*(field(body, f"{k}.{i}") for i in INNER_KEYS))
        named = lambda raw: F.when(raw.startswith("["), first(F.from_json(raw, "array<string>"))).otherwise(match(F.when(raw.startswith("{"), inner).otherwise(raw), hypotheses))
        return once(field(body, k), lambda raw: F.when(raw.isNotNull(), named(raw)))

    # a later key is read only where those before it name nothing
    return once(unfenced(content), lambda body: F.coalesce(*(chosen(body, k) for k in PICK_KEYS), once(field(body, "reasoning"), lambda raw: F.when(raw.isNotNull(), match(raw, hypotheses)))))


def probabilities(content: Column, hypotheses: Column) -> Column:
    """A map over all hypotheses: from the answer's object or else its text, percentages rescaled, normalised; else uniform."""
    uniform = F.transform(hypotheses, lambda h: F.lit(1.0) / F.size(hypotheses))
    given = lambda body: F.coalesce(*(F.from_json(field(body, k), "map<string,string>") for k in ("probabilities", "probs")))
    loose = lambda text, h: F.call_function("regexp_extract", text, F.concat(F.lit('"'), h, F.lit('"\\s*:\\s*([0-9]*\\.?[0-9]+)')), F.lit(1))

    def values(text: Column) -> Column:
        found = lambda h: once(loose(text, h), lambda x: F.when(x != "", x.try_cast("double")))  # noqa: E731 (a cast of '' is an exception inside)
        read = lambda m: F.transform(hypotheses, lambda h: F.coalesce(F.try_element_at(m, h).try_cast("double"), found(h)))
        return once(once(unfenced(text), given), read)

    def shares(values: Column) -> Column:
        whole = ~F.exists(values, lambda v: v.isNull())
        scaled = F.when(F.exists(values, lambda v: v > 1.5), F.transform(values, lambda v: v / 100)).otherwise(values)
        normal = lambda p, total: F.when(F.coalesce(whole & (total > 0), F.lit(False)), F.transform(p, lambda v: F.least(v / total, F.lit(1.0)))).otherwise(uniform)
        return once(F.transform(scaled, lambda v: F.greatest(v, F.lit(0.0))), lambda p: once(F.aggregate(p, F.lit(0.0), lambda s, v: s + v), lambda total: normal(p, total)))

    return F.map_from_arrays(hypotheses, once(once(content, values), shares))


def normalised(weights: Column, hypotheses: Column) -> Column:
    """A map of weights as probabilities over the hypotheses; uniform where their sum is nearly nothing."""
    values = F.transform(hypotheses, lambda h: F.greatest(F.coalesce(F.try_element_at(weights, h), F.lit(0.0)), F.lit(0.0)))
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    return F.map_from_arrays(hypotheses, F.transform(values, lambda v: F.when(total < 1e-9, F.lit(1.0) / F.size(hypotheses)).otherwise(v / total)))


def argmax(weights: Column, hypotheses: Column) -> Column:
    """The hypothesis of the largest weight, the first of equals."""
    rows = lambda w: F.transform(F.sequence(F.lit(1), F.size(hypotheses)), lambda i: F.struct(F.coalesce(F.try_element_at(w, F.try_element_at(hypotheses, i)), F.lit(0.0)).alias("p"), (-i).alias("i")))
    return F.try_element_at(hypotheses, -F.array_max(once(weights, rows))["i"])


def fitted(items: Column, size: int) -> Column:
    """Trimmed, non-empty, cut or padded to `size` elements."""
    kept = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(F.concat(kept, F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.concat(F.lit("indicator "), i.cast("string")))), 1, size)


def claims(content: Column) -> Column:
    """Texts and numbers of the answer's list of claims, or else of facts, trimmed, without empty ones."""
    body = unfenced(content)
    lists = [F.from_json(F.get_json_object(body, f"$.{k}"), "array<string>") for k in ("claims", "facts")]
    given = F.coalesce(F.when(F.size(lists[0]) > 0, lists[0]), lists[1], F.array().cast("array<string>"))
    return F.filter(F.transform(given, lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("{") & ~x.startswith("["))


def scattered(content: Column, key: str, value: str, size: int, default: float) -> Column:
    """An array of `size` numbers from the answer's list of {id, value}: ids count from 1, those out of range are left out, the last of several stays, values are clipped to [0, 1]."""
    entries = F.from_json(F.get_json_object(unfenced(content), f"$.{key}"), f"array<struct<id:int,{value}:double>>")
    own = lambda i: F.try_element_at(F.filter(entries, lambda e: e["id"] == i), F.lit(-1))[value]
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.coalesce(F.least(F.greatest(own(i), F.lit(0.0)), F.lit(1.0)), F.lit(default)))
