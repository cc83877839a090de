"""Text functions as Column expressions: search tokens, normalisers, hashes, globs."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The character ranges that are searched one character at a time.
CJK_RANGES = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F))
CJK = "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in CJK_RANGES)
#: One token: a CJK character, or a run of letters and digits that aren't CJK.
TOKEN = rf"[{CJK}]|[\p{{L}}\p{{N}}&&[^{CJK}]]+"


def _folding() -> tuple[str, str]:
    """Letters of Latin blocks whose decomposition starts with one ASCII letter, and that letter."""
    found = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if chr(c).islower()]
    found = [(c, base) for c, base in found if base.isascii() and base != c]
    return "".join(c for c, _ in found), "".join(b for _, b in found)


FOLD_FROM, FOLD_TO = _folding()
_FOLDED = str.maketrans(FOLD_FROM, FOLD_TO)


def fold(text: Column) -> Column:
    """Lower case without the diacritics of Latin letters."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def folded(tokens: pa.StringArray) -> pa.StringArray:
    """Lower-case tokens of a batch without the diacritics of Latin letters, as fold() makes them."""
    other = pc.invert(pc.string_is_ascii(tokens))
    return pc.replace_with_mask(tokens, other, pa.array([t.translate(_FOLDED) for t in tokens.filter(other).to_pylist()], tokens.type))


def units(text: Column) -> Column:
    """The tokens of a text in order, duplicates kept, diacritics kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def index_terms(text: Column) -> Column:
    """The tokens as the index holds them, diacritics folded."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def search_form(text: Column) -> Column:
    """Tokens joined by one space: the form that phrases are sought in."""
    return F.array_join(units(text), " ")


def phrase_hit(text: Column, needle: Column) -> Column:
    return (F.length(needle) > 0) & (F.instr(search_form(text), needle) > 0)


def duplicate_form(text: Column) -> Column:
    """Lower case, white space collapsed: equal forms are duplicates."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def one_line_end(text: Column) -> Column:
    """The text with line feeds alone as line ends."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)


def hash_form(text: Column) -> Column:
    """One kind of line end, no blanks at line ends, no blank lines at either edge."""
    text = F.coalesce(text, F.lit(""))
    stripped = F.regexp_replace(one_line_end(text), r"[\s&&[^\n]]+(?=\n|\z)", "")
    # Most texts are in this form already, which byte searches tell sooner than expressions.
    blanks = " \t\x0b\x0c\r"
    off = reduce(lambda a, b: a | b, [F.contains(text, F.lit("\r")), text.startswith("\n"), text.endswith("\n"), *[text.endswith(c) | F.contains(text, F.lit(f"{c}\n")) for c in blanks]])
    return F.when(off, F.regexp_replace(stripped, r"\A\n+|\n+\z", "")).otherwise(text)


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(hash_form(text), 256))


def slug(scope: Column) -> Column:
    """A file name of a scope; equal slugs of different scopes are told apart by the exporter."""
    made = F.regexp_replace(F.regexp_replace(scope, r"[^0-9A-Za-z._\x{4E00}-\x{9FFF}-]+", "-"), r"^-+|-+$", "")
    return F.when(made == "", F.lit("scope")).otherwise(made)


def preview(text: Column, limit: int = 120) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit), F.lit("...")))


def tags(values: Column) -> Column:
    """Trimmed, without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""))


def json_or_text(raw: Column) -> Column:
    """A VARIANT: the value if it is JSON, the plain string if not."""
    text = F.trim(raw)
    return F.coalesce(F.try_parse_json(text), text.cast("variant"))


def json_fields(text: Column) -> Column:
    """The fields of a JSON object as MAP<STRING, VARIANT>; of anything else, none."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def json_merged(*fields: Column) -> Column:
    """One JSON object of several field maps, later ones before earlier ones; keys sorted at every level, as a VARIANT holds them."""

    def before(earlier: Column, later: Column) -> Column:
        return F.map_concat(F.map_filter(earlier, lambda k, v: ~F.map_contains_key(later, k)), later)

    return F.to_json(F.parse_json(F.to_json(reduce(before, fields))))


def external_ref(vault: Column, path: Column) -> Column:
    return F.concat(F.lit("obsidian:"), vault, F.lit("/"), F.regexp_replace(F.translate(path, "\\", "/"), "^/+", ""))


def parse_ref(ref: Column) -> Column:
    """STRUCT<vault_id, rel_path>; null fields where the reference has none."""
    inside = F.regexp_extract(ref, "(?s)^obsidian:(.*)$", 1)
    ours = ref.startswith("obsidian:")
    cut = F.instr(inside, "/") > 0
    return F.struct(
        F.when(ours, F.when(cut, F.substring_index(inside, "/", 1)).otherwise(inside)).alias("vault_id"),
        F.when(ours & cut, F.regexp_replace(inside, "(?s)^[^/]*/", "")).alias("rel_path"),
    )


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression over '/'-separated relative paths.

    `**` spans any number of segments, `*`, `?` and `[...]` stay inside one; a pattern without
    a slash is matched with the last segment; case doesn't count.
    """
    pattern = pattern.replace("\\", "/")
    parts = [p for p in pattern.split("/") if p]
    if not parts:
        return r"(?!)"

    def segment(part: str) -> str:
        out, i = [], 0
        while i < len(part):
            c = part[i]
            close = part.find("]", i + 2) if c == "[" else -1
            if c == "*":
                out.append("[^/]*")
            elif c == "?":
                out.append("[^/]")
            elif close > 0:
                inside = part[i + 1 : close].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
                out.append(f"[^/{inside[1:]}]" if inside.startswith("!") else f"[{'\\' * inside.startswith('^')}{inside}]")
                i = close
            else:
                out.append(re.escape(c))
            i += 1
        return "".join(out)

    if "/" not in pattern:
        return rf"(?is)^(?:.*/)?{segment(parts[0]) if parts[0] != '**' else '[^/]*'}$"
    # Segments carry a slash each, so that ** can stand for none of them.
    return "(?is)^" + "".join("(?:[^/]+/)*" if p == "**" else segment(p) + "/" for p in parts) + "$"


def matches_glob(path: Column, pattern: str) -> Column:
    clean = F.regexp_replace(F.translate(path, "\\", "/"), r"^(?:\./)*/*", "")
    clean = F.regexp_replace(clean, "/+", "/")
    if "/" in pattern.replace("\\", "/"):
        clean = F.concat(F.regexp_replace(clean, "/+$", ""), F.lit("/"))
    return clean.rlike(glob_regex(pattern))


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
