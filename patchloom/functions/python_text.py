"""Text functions that no built-in expresses: sequence matching, GB18030, YAML. Arrow batches, never row by row calls."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two names by matching blocks, 0 to 1; null counts as empty."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _myers(a: str, b: str) -> int:
    """Levenshtein distance by Myers' bit vectors in Hyyro's form: a column of the table is two integers, which hold
    where it rises and where it falls. Common ends are cut first."""
    n = min(len(a), len(b))
    i = next((k for k in range(n) if a[k] != b[k]), n)
    a, b = a[i:], b[i:]
    n = min(len(a), len(b))
    j = next((k for k in range(n) if a[-1 - k] != b[-1 - k]), n)
    a, b = a[: len(a) - j], b[: len(b) - j]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    ones, top, score = (1 << len(a)) - 1, len(a) - 1, len(a)
    rises, falls = ones, 0
    for c in b:
        same = places.get(c, 0)
        diagonal = ((((same & rises) + rises) ^ rises) | same | falls) & ones
        right_up, right_down = (falls | ~(diagonal | rises)) & ones, rises & diagonal
        score += (right_up >> top & 1) - (right_down >> top & 1)
        right_up, right_down = (right_up << 1 | 1) & ones, right_down << 1 & ones
        rises, falls = (right_down | ~(diagonal | right_up)) & ones, right_up & diagonal
    return score


@F.pandas_udf(IntegerType())
def bit_parallel_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Levenshtein distance of code points, for long texts; null with a null."""
    return pd.Series([None if x is None or y is None else _myers(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def token_counter(path: str):
    """A function of a column that counts tokens with the tokenizer in a file of the tokenizers library."""

    @F.pandas_udf(IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for texts in batches:
            yield pd.Series([len(e.ids) for e in tokenizer.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)], dtype="int32")

    return count


def _changed(before: str | None, after: str | None) -> int:
    old, new = ([s for line in (x or "").splitlines() if (s := line.strip())] for x in (before, after))
    spans = difflib.SequenceMatcher(None, old, new).get_opcodes()
    return sum(max(i2 - i1, j2 - j1) for kind, i1, i2, j1, j2 in spans if kind != "equal")


@F.pandas_udf(IntegerType())
def changed_lines(before: pd.Series, after: pd.Series) -> pd.Series:
    """Trimmed lines, blank ones left out, that differ between two texts."""
    return pd.Series([_changed(x, y) for x, y in zip(before, after, strict=True)], dtype="int32")


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("encoding", StringType())]))
def decode(content: pd.Series) -> pd.DataFrame:
    """Bytes as UTF-8, else as GB18030, else as UTF-8 with replacement; null stays null."""

    def one(raw):
        if raw is None:
            return None, None
        for encoding in ("utf-8", "gb18030"):
            try:
                return bytes(raw).decode(encoding), encoding
            except UnicodeDecodeError:
                continue
        return bytes(raw).decode("utf-8", "replace"), "utf-8-replaced"

    return pd.DataFrame([one(x) for x in content], columns=["text", "encoding"])


def decode_text(raw: bytes) -> str:
    """Bytes as UTF-8, else as GB18030 with replacement: the rule of testcases."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("gb18030", "replace")


def _scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1].replace("''", "'") if text[0] == "'" else bytes(text[1:-1], "utf-8").decode("unicode_escape")
    text = text.split(" #")[0].strip()
    return int(text) if text.lstrip("-").isdigit() else None if text in ("", "null", "~") else text


def read_yaml(text: str) -> dict:
    """Nested `key: value` lines of YAML by their indentation, which is all that testcases' settings have: the same with
    any set of packages. Lists and comments are passed over."""
    root: dict = {}
    open_at = [(-1, root)]
    for line in text.splitlines():
        key, colon, value = line.partition(":")
        indent = len(line) - len(line.lstrip())
        if not colon or key.strip().startswith(("#", "-")):
            continue
        while open_at[-1][0] >= indent:
            open_at.pop()
        if value.strip() and not value.strip().startswith("#"):
            open_at[-1][1][key.strip()] = _scalar(value)
        else:
            inner: dict = {}
            open_at[-1][1][key.strip()] = inner
            open_at.append((indent, inner))
    return root


def parse_config(argv: str | None = None, text: str | None = None, timeout: int = 90, simulating_time: str = "1000ns") -> dict:
    """A testcase's settings: `universal` of the JSON argv if there is one, else judge_parameter.universal of the YAML;
    absent keys have defaults."""
    import json

    found = json.loads(argv).get("universal", {}) if argv is not None else (read_yaml(text or "").get("judge_parameter") or {}).get("universal", {})
    return {"timeout": int(found.get("timeout", timeout)), "simulating_time": str(found.get("simulating_time", simulating_time)), "output_regex": found.get("output_regex"), "top_module": found.get("top_module")}
