"""Text features, free-text parsing and formatting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code features: name and pattern (fixed values, Java syntax).
FEATURES = {
    "n_if": r"\bif\s*\(",
    "n_loop": r"\b(?:for|while)\s*\(",
    "n_call": r"\w+\s*\(",
    "n_return": r"\breturn\b",
    "n_assign": r"[^=!<>]=[^=]",
    "n_string": r"\"[^\"]*\"",
    "n_number": r"\b\d+\b",
    "n_catch": r"\bcatch\b",
}


def count(text: str | Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def features(text: str = "text") -> list[Column]:
    return [count(text, p).cast("long").alias(n) for n, p in FEATURES.items()]


def lines(text: str) -> Column:
    """Lines with something on them."""
    return F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x) != "")


def loc(text: str) -> Column:
    return F.size(lines(text)).cast("long")


def nesting(text: str, left: str = "(", right: str = ")") -> Column:
    """Deepest nesting of brackets; depth never falls below 0. A fold over the brackets alone, in their order."""
    marks = F.split(F.regexp_replace(F.col(text), rf"[^\{left}\{right}]", ""), "")
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("top"))

    def step(acc: Column, x: Column) -> Column:
        d = F.when(x == left, acc["d"] + 1).when(x == right, F.greatest(acc["d"] - 1, F.lit(0))).otherwise(acc["d"])
        return F.struct(d.alias("d"), F.greatest(acc["top"], d).alias("top"))

    return F.aggregate(marks, start, step, lambda acc: acc["top"])


def cwe(text: str, strip_zeros: bool = False) -> Column:
    """The first run of digits as a CWE id; CWE-UNKNOWN without one."""
    digits = F.regexp_extract(F.coalesce(F.col(text), F.lit("")), r"(\d+)", 1)
    shown = F.regexp_replace(digits, "^0+(?=.)", "") if strip_zeros else digits
    return F.when(digits == "", "CWE-UNKNOWN").otherwise(F.concat(F.lit("CWE-"), shown))


def last_json(text: str, fields: str) -> Column:
    """The last flat JSON object in free text that parses, as a struct of fields; null without one."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(\{[^{}]*\})"), 1)
    good = F.filter(found, lambda x: F.try_parse_json(x).isNotNull())
    return F.from_json(F.try_element_at(good, F.lit(-1)), fields)


def json_array(text: str) -> Column:
    """A JSON array in free text: comments go, doubled quotes become one, the outermost brackets count; else each flat
    object. Gives an array of JSON texts."""
    clean = F.regexp_replace(F.regexp_replace(F.col(text), r"//[^\n]*", ""), '""', '"')
    outer = F.regexp_extract(clean, r"(?s)(\[.*\])", 1)
    whole = F.when(F.try_parse_json(outer).isNotNull(), F.from_json(outer, "array<string>"))
    return F.coalesce(whole, F.filter(F.regexp_extract_all(clean, F.lit(r"(\{[^{}]*\})"), 1), lambda x: F.try_parse_json(x).isNotNull()))


def truth(value: str | Column) -> Column:
    """Bool-like strings; null for what is neither."""
    v = F.lower(F.trim(F.col(value) if isinstance(value, str) else value))
    return F.when(v.isin("true", "yes", "1", "y"), True).when(v.isin("false", "no", "0", "n"), False)


def after_thinking(text: str) -> Column:
    return F.element_at(F.split(F.col(text), "</think>"), -1)


def without_thinking(text: str) -> Column:
    return F.regexp_replace(F.col(text), r"(?is)<think>.*?</think>", "")


def verdict(text: str) -> Column:
    """1 or 0 from the last explicit verdict, else from phrases ("not vulnerable" first); null without any."""
    said = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"verdict\s*[:=]\s*\"?(vulnerable|safe|true|false)"), 1)
    last = F.try_element_at(said, F.lit(-1))
    low = F.lower(F.col(text))
    phrase = F.when(F.contains(low, F.lit("not vulnerable")), 0).when(F.contains(low, F.lit("vulnerable")), 1)
    return F.when(last.isin("vulnerable", "true"), 1).when(last.isin("safe", "false"), 0).otherwise(phrase)


def chain(column: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered replacements."""
    for pattern, by in rules:
        column = F.regexp_replace(column, pattern, by)
    return column


#: Anonymising replacements, in order (fixed values).
ANONYMOUS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "EMAIL"),
    (r"https?://[^ \n\"]+", "URL"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "ADDRESS"),
    (r"\b[0-9a-f]{32,}\b", "DIGEST"),
    (r"\d+", "0"),
]


def named(text: str, aliases: str) -> Column:
    """Whether any of the names, parted by |, occurs in the text, whatever its case."""
    return F.exists(F.split(F.col(aliases), r"\|"), lambda x: (F.trim(x) != "") & F.contains(F.lower(F.col(text)), F.lower(F.trim(x))))


def clipped(text: str, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(F.col(text), F.lit(n)), F.lit("..."))).otherwise(F.col(text))


def window_of(text: str, at: str, width: int) -> Column:
    """At most width lines around line number at (from 1), with a mark where lines are left out."""
    ls = F.split(F.col(text), "\n")
    n = F.size(ls)
    first = F.greatest(F.lit(1), F.least(F.col(at).cast("int") - width // 2, n - width + 1))
    cut = F.slice(ls, first, F.lit(width))
    head = F.when(first > 1, F.array(F.lit("// ..."))).otherwise(F.array().cast("array<string>"))
    tail = F.when(first + width - 1 < n, F.array(F.lit("// ..."))).otherwise(F.array().cast("array<string>"))
    return F.when(n <= width, F.col(text)).otherwise(F.array_join(F.concat(head, cut, tail), "\n"))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: str) -> Column:
    """The vector over its length, itself if that is 0."""
    n = F.sqrt(dot(a, a))
    return F.when(n > 0, F.transform(F.col(a), lambda x: x.cast("double") / n)).otherwise(F.col(a).cast("array<double>"))


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def softmax2(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return F.exp(a - top) / (F.exp(a - top) + F.exp(b - top))


def verdict_probability(tokens: str, yes: str = "true", no: str = "false", mark: str = "</think>") -> Column:
    """The probability of yes against no at the last of the two among the tokens after the mark; null where neither
    stands there or has alternatives.

    tokens: array of struct(token, top: array of struct(token, logprob)). The mark may be spread over several tokens;
    without one all tokens count. Of alternatives that are equal but for blanks the first counts.
    """
    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(0).alias("end"))

    def read(acc: Column, t: Column) -> Column:
        text, n = F.concat(acc["text"], t["token"]), acc["n"] + 1
        return F.struct(text.alias("text"), n.alias("n"), F.when((acc["end"] == 0) & F.contains(text, F.lit(mark)), n).otherwise(acc["end"]).alias("end"))

    end = F.aggregate(tokens, zero, read)["end"]
    after = F.slice(F.col(tokens), end + 1, F.size(tokens))
    last = F.try_element_at(F.filter(after, lambda t: F.trim(t["token"]).isin(yes, no)), F.lit(-1))

    def of(word: str) -> Column:
        first = F.try_element_at(F.filter(last["top"], lambda a: F.trim(a["token"]) == word), F.lit(1))
        return F.coalesce(F.exp(first["logprob"]), F.lit(0.0))

    return F.try_divide(of(yes), F.nullif(of(yes) + of(no), F.lit(0.0)))


def literal_dict(text: str, fields: str) -> Column:
    """A dict as Python prints it, with numbers as values."""
    return F.from_json(F.replace(F.col(text), F.lit("'"), F.lit('"')), fields)


def description(text: str, most: int = 11) -> Column:
    """The first lines of a text that begin with a letter, trimmed; headings, badges and blanks are passed over."""
    trimmed = F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x))
    return F.array_join(F.slice(F.filter(trimmed, lambda x: F.rlike(x, F.lit(r"^\p{L}"))), 1, most), "\n")


#: Comments, strings, identifiers, and what stands between them (Java syntax).
TOKENS = r"(//[^\n]*|/\*(?s:.*?)\*/|\"(?:[^\"\\\n]|\\.)*\"|[A-Za-z_]\w*|[^A-Za-z_\"/]+|[\"/])"


def renamed(df: DataFrame, text: str, keep: list[str], strict: bool = False, name: str = "renamed") -> DataFrame:
    """df with text's identifiers outside keep renamed by first occurrence in the document: CONST1, Cls1, name1. With
    strict, comments go and strings are numbered too.

    A document's names are listed once, each token finds its place among them; the lists are columns of their own, so
    they are not worked out again for each token.
    """
    kept = F.array(*map(F.lit, keep)) if keep else F.array().cast("array<string>")
    constant = lambda t: (t == F.upper(t)) & (F.length(t) > 1) & F.rlike(t, F.lit("[A-Z]"))
    capital = lambda t: F.rlike(t, F.lit("^[A-Z]")) & ~constant(t)
    kinds = {"CONST": constant, "Cls": capital, "name": lambda t: ~constant(t) & ~capital(t)}
    df = df.withColumn("_tokens", F.regexp_extract_all(F.col(text), F.lit(TOKENS), 1))
    df = df.withColumn("_found", F.array_distinct(F.filter("_tokens", lambda t: F.rlike(t, F.lit("^[A-Za-z_]")) & ~F.array_contains(kept, t))))
    df = df.withColumns({f"_{prefix}": F.filter("_found", own) for prefix, own in kinds.items()})
    df = df.withColumn("_strings", F.array_distinct(F.filter("_tokens", lambda t: F.startswith(t, F.lit('"')) & (F.length(t) > 1))))

    def shown(t: Column) -> Column:
        out = t
        for prefix in kinds:
            at = F.array_position(F.col(f"_{prefix}"), t)
            out = F.when(at > 0, F.concat(F.lit(prefix), at.cast("string"))).otherwise(out)
        if strict:
            at = F.array_position(F.col("_strings"), t)
            out = F.when(F.rlike(t, F.lit(r"^(//|/\*)")), "").when(at > 0, F.concat(F.lit('"s'), at.cast("string"), F.lit('"'))).otherwise(out)
        return out

    return df.withColumn(name, F.array_join(F.transform("_tokens", shown), "")).drop("_tokens", "_found", "_strings", *(f"_{p}" for p in kinds))
