"""Text functions over columns: source code, comments, fences, judge output, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chinese characters as comments are searched for, and as similarity keys keep them; white space and word
# characters as Python knows them; the replacement character; how lines of every template header begin.
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
KEY_CJK = r"\x{3400}-\x{9FFF}"
BLANK = r"\x{09}-\x{0D}\x{1C}-\x{1F}\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"
REPLACEMENT = "\ufffd"
HEADER_MARKS = ["// Company:", "// Create Date:", "// Module Name:", "// Additional Comments:"]

#: Tokens of C-like code, in order of trial: string, escaped identifier with its white space, line comment, block
#: comment (or one that never ends), other characters, a lone slash or backslash.
CODE_TOKEN = rf'"(?:[^"\\]++|\\[\s\S])*+"?|\\[^{BLANK}]++[{BLANK}]?|//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)|[^"/\\]++|[/\\]'


def without_line_ends(code: Column) -> Column:
    return F.translate(code, "\r\n", "")


def edit_distance(before: Column, after: Column) -> Column:
    """Levenshtein distance of code points, as a share of the longer text; line ends don't count."""
    a, b = without_line_ends(before), without_line_ends(after)
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def length_change(before: Column, after: Column) -> Column:
    return F.abs(F.length(after) - F.length(before)) / F.greatest(F.length(before), F.length(after), F.lit(1))


def _code_tokens(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(CODE_TOKEN), F.lit(0))


def _comment_gone(token: Column) -> Column:
    block = F.concat(F.lit(" "), F.regexp_replace(token, r"[^\n]", ""))
    return F.when(token.startswith("//"), F.lit("")).when(token.startswith("/*"), block).otherwise(token)


def strip_comments(code: Column) -> Column:
    """Without comments: a line comment goes, a block becomes one blank and its line ends; lines are stripped at the right."""
    return right_strip(_without(code, lambda t: F.lit(True)))


def _without(code: Column, gone) -> Column:
    """code without the comments that `gone` picks."""
    whole = F.array_join(F.transform(_code_tokens(code), lambda t: F.when(gone(t), _comment_gone(t)).otherwise(t)), "")
    return F.when(F.contains(code, F.lit("//")) | F.contains(code, F.lit("/*")), whole).otherwise(code)


def right_trim(text: Column) -> Column:
    """Lines without blanks and tabs at their ends. Texts that have none pass without a search."""
    ends = F.lit(False)
    for mark in " \t":
        ends = ends | F.contains(text, F.lit(f"{mark}\n")) | F.endswith(text, F.lit(mark))
    return F.when(ends, F.regexp_replace(text, r"[ \t]++(\n|\z)", "$1")).otherwise(text)


def right_strip(text: Column) -> Column:
    """Lines, ended by \\n alone, without white space of any kind at their ends."""
    return F.regexp_replace(text, r"[\x09\x0B-\x0D\x1C-\x1F\x85\p{Z}]++(\n|\z)", "$1")


def is_cjk_comment(token: Column) -> Column:
    return (token.startswith("//") | token.startswith("/*")) & token.rlike(f"[{CJK}]")


def strip_cjk_comments(code: Column) -> Column:
    """Without the comments that hold Chinese; blank edges go too, and one line end closes the text (none: empty)."""
    return _let(_without(code, is_cjk_comment), lambda bare: close_text(right_trim(bare)))


def count_cjk_comments(code: Column) -> Column:
    return F.size(F.filter(_code_tokens(code), is_cjk_comment))


def close_text(code: Column) -> Column:
    """Without blank lines at the edges, with one line end at the close; empty stays empty."""
    return _let(F.btrim(code, F.lit("\n")), lambda bare: F.when(bare == "", F.lit("")).otherwise(F.concat(bare, F.lit("\n"))))


def _let(value: Column, f) -> Column:
    """f(value), the value written once: an expression that names it twice would hold it twice."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: A separator: a line of at least 20 slashes.
SEPARATOR = r"/{20,}+"


def drop_headers(lines: Column, marks: list[str] = HEADER_MARKS) -> Column:
    """Lines without template headers: a separator among the first 10 lines up to the next one within 39 lines, if
    lines between begin with all the marks; else the next separator is tried. It is done again until nothing is found,
    so at most as often as there are separators."""

    def separates(line: Column) -> Column:
        return F.coalesce(line.rlike(f"^{SEPARATOR}\\z"), F.lit(False))

    def header_end(ls: Column, start: Column) -> Column:
        """The place of the closing separator, or null."""
        later = F.filter(F.sequence(start + 1, start + 39), lambda k: separates(F.get(ls, k)))
        has_marks = lambda inner: F.forall(F.array(*map(F.lit, marks)), lambda m: F.exists(inner, lambda line: F.startswith(line, m)))
        return _let(F.get(later, F.lit(0)), lambda e: F.when(has_marks(F.slice(ls, start + 2, F.greatest(e - start - 1, F.lit(0)))), e))

    def once(ls: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda k: separates(F.get(ls, k)))
        spans = F.filter(F.transform(starts, lambda k: F.struct(k.alias("a"), header_end(ls, k).alias("e"))), lambda x: x["e"].isNotNull())
        cut = lambda x: F.concat(F.slice(ls, F.lit(1), x["a"]), F.slice(ls, x["e"] + 2, F.size(ls)))
        return _let(F.get(spans, F.lit(0)), lambda x: F.when(x.isNull(), ls).otherwise(cut(x)))

    return _let(lines, lambda ls: F.aggregate(F.sequence(F.lit(0), F.size(F.filter(ls, separates))), ls, lambda now, _: once(now)))


def headers_removed(code: Column, marks: list[str] = HEADER_MARKS) -> Column:
    """How many template headers normalise_code removes: each takes its two separators with it, and no others go."""
    separators = lambda ls: F.size(F.filter(ls, lambda x: x.rlike(f"^{SEPARATOR}\\z")))
    lines = F.split(unify_lines(code), "\n", -1)
    return _let(lines, lambda ls: F.when(separators(ls) > 1, F.floor((separators(ls) - separators(drop_headers(ls, marks))) / 2).cast("int")).otherwise(0))


def unify_lines(code: Column) -> Column:
    """\\r\\n and \\r as \\n, no blanks or tabs at line ends."""
    feeds = F.when(F.contains(code, F.lit("\r")), F.regexp_replace(code, r"\r\n?", "\n")).otherwise(code)
    return _let(feeds, right_trim)


def normalise_code(code: Column, marks: list[str] | None = None) -> Column:
    def headless(text: Column) -> Column:
        bare = F.array_join(drop_headers(F.split(text, "\n", -1), marks), "\n")
        return F.when(text.rlike(f"(?md)^{SEPARATOR}$"), bare).otherwise(text)  # without a separator there is no header

    return _let(unify_lines(code), lambda text: _let(headless(text) if marks else text, close_text))


def extract_fences(answer: Column) -> Column:
    """The fenced blocks of an answer as they stand, joined by two line ends; the whole answer without any. The edges
    of the result are stripped, and one line end closes it."""
    blocks = F.regexp_extract_all(answer, F.lit(rf"(?isu)```(?:verilog|systemverilog|sv)?[{BLANK}]*\n(.*?)```"), F.lit(1))
    return _let(blocks, lambda bs: F.concat(py_strip(F.when(F.size(bs) > 0, F.array_join(bs, "\n\n")).otherwise(answer)), F.lit("\n")))


def py_strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{BLANK}]++|[{BLANK}]++\z", "")


def output_matches(output: Column, pattern: str, squeezed: bool = False) -> Column:
    """Matches of a pattern whose ^ and $ are a line's: trimmed, \\r\\n counting as \\n; or, of the other judge, with all
    white space squeezed and the output as it stands."""
    feeds = output if squeezed else F.replace(output, F.lit("\r\n"), F.lit("\n"))
    return F.transform(F.regexp_extract_all(feeds, F.lit(f"(?md){pattern}"), F.lit(0)), squeeze if squeezed else py_strip)


def output_lines(output: Column) -> Column:
    """Trimmed lines that are not blank; lines end where Python's splitlines ends them."""
    return F.filter(F.transform(F.split(output, LINE_END), py_strip), lambda x: x != "")


#: Where Python's splitlines ends a line.
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"


def line_count(text: Column) -> Column:
    """Lines as splitlines counts them: what ends the text begins no line."""
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(F.regexp_replace(text, f"(?:{LINE_END})\\z", ""), LINE_END, -1)))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"[{BLANK}]++", " "))


def compact(text: Column, most: int = 100) -> Column:
    """White space squeezed, cut with an ellipsis."""
    short = squeeze(text)
    return F.when(F.length(short) > most, F.concat(F.substring(short, 1, most - 1), F.lit("…"))).otherwise(short)


def similarity_key(text: Column) -> Column:
    """Lower case; digits, a-z and Chinese alone. Taking out what stays is five times as fast as replacing the rest."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(f"[0-9a-z{KEY_CJK}]+"), F.lit(0)), "")


def grams(key: Column, n: int = 5) -> Column:
    """Distinct n-character substrings, in time that grows with the text: F.substring would count its way to each place."""
    places = F.when(F.length(key) >= n, F.sequence(F.lit(1), F.length(key) - n + 1)).otherwise(F.array().cast("array<int>"))
    cut = lambda chars: F.transform(places, lambda i: F.array_join(F.slice(chars, i, F.lit(n)), ""))
    wide = F.get(F.transform(F.array(F.split(key, "")), cut), F.lit(0))  # a regular expression would meet halves of such characters
    found = F.regexp_extract_all(key, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    some = F.when(key.rlike(r"[\x{10000}-\x{10FFFF}]"), wide).otherwise(found)
    return F.array_distinct(F.coalesce(some, F.array().cast("array<string>")))


def containment(a: Column, b: Column) -> Column:
    """Shared grams as a share of the smaller set; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def code_hash(code: Column) -> Column:
    """SHA-256 of the code without white space."""
    return F.sha2(F.regexp_replace(code, rf"[{BLANK}]++", ""), 256)


def keyed_hash(key: Column, code: Column) -> Column:
    return F.sha2(F.concat(key.cast("string"), F.lit("\0"), code), 256)


def clean_optional(text: Column) -> Column:
    """Null for blank, "null" and "none", whatever white space is about them; other text as it stands."""
    return F.when(F.lower(py_strip(text)).isin("", "null", "none"), F.lit(None)).otherwise(text)


def extension(name: Column) -> Column:
    return F.coalesce(F.regexp_substr(F.lower(name), F.lit(r"\.[^.]+$")), F.lit("<none>"))


def module_names(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(rf"(?<![{WORD}])module[{BLANK}]+([A-Za-z_$][{WORD}$]*)"), F.lit(1))


def expected_module(text: Column) -> Column:
    """The name that a line `Module: name` gives, or null."""
    return F.get(F.regexp_extract_all(text, F.lit(rf"(?md)^Module:[{BLANK}]*([{WORD}]+)"), F.lit(1)), F.lit(0))


def rename_module(code: Column, old: str, new: str) -> Column:
    """The first `module old` becomes `module new`; words that begin or end with `old` don't count."""
    return F.regexp_replace(code, rf"(?s)\A(.*?)(?<![{WORD}])module[{BLANK}]+\Q{old}\E(?![{WORD}])", f"$1module {new}")


def patch_submission(code: Column) -> Column:
    """Two semicolons with blanks and tabs between them become one, from left to right; of three, two stay."""
    return F.regexp_replace(code, r";[ \t]*;", ";")


def table_cell(text: Column) -> Column:
    """Tabs and line ends as blanks."""
    return F.translate(text, "\t\r\n", "   ")


def percent(x: Column) -> Column:
    return F.format_string("%.2f%%", 100 * x)


def signed_points(x: Column) -> Column:
    return F.format_string("%+.2f", 100 * x)


def nanoseconds(text: Column) -> Column:
    """A simulation time such as 1.5us in nanoseconds; null for another form (blanks around it, two points, other units)."""
    form = r"\A([0-9.]+)\s*(s|ms|us|ns|ps|fs)\z"
    scale = F.create_map(*[F.lit(x) for pair in {"s": 1e9, "ms": 1e6, "us": 1e3, "ns": 1.0, "ps": 1e-3, "fs": 1e-6}.items() for x in pair])
    return F.when(text.rlike(form), F.regexp_extract(text, form, 1).try_cast("double") * scale[F.regexp_extract(text, form, 2)])


def clamped_timeout(own: Column, wall: int) -> Column:
    """A testcase's seconds, 90 if it names none, at most the wall's."""
    return F.least(F.coalesce(own, F.lit(90)), F.lit(wall))


def draw(seed: int | str, key: Column) -> Column:
    """A number in [0, 1) from SHA-256 of "seed:key", the same in any engine."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)
