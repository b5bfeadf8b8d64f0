"""Text clean-up, description blocks, notices and prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .. import constants as K

# Fixed value: how a description block begins.
HEADER_LINE = r"^> \*\*(?:Image description|Image Description|Image)\.\*\*"
#: Items that a walk appends to one array.
WALK_BLOCK = 512


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), 0)


def walk(items: Column, state: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """(state, out) after a walk over items: ``step(state, item)`` is (state, out), its ``out`` an array of ``kind``; all outputs follow each other.

    The walk goes block by block, so that no long array is copied at each item and its time is in proportion to the items.
    """
    count = lambda its: F.when(F.size(its) > 0, F.floor((F.size(its) - 1) / WALK_BLOCK)).otherwise(0).cast("int")
    blocks = let(items, lambda its: F.transform(F.sequence(F.lit(0), count(its)), lambda k: F.slice(its, k * WALK_BLOCK + 1, F.lit(WALK_BLOCK))))
    struct = lambda state, out: F.struct(state.alias("state"), out.alias("out"))

    def one(acc: Column, item: Column) -> Column:
        return let(step(acc["state"], item), lambda done: struct(done["state"], F.concat(acc["out"], done["out"])))

    def block(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, struct(acc["state"], F.array().cast(f"array<{kind}>")), one)
        return let(inner, lambda done: struct(done["state"], F.array_append(acc["out"], done["out"])))

    return F.aggregate(blocks, struct(state, F.array().cast(f"array<array<{kind}>>")), block, lambda acc: struct(acc["state"], F.flatten(acc["out"])))


#: The code points that count as white space.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANKS))


def strip_newlines(text: Column) -> Column:
    return F.btrim(text, F.lit("\n"))


def present(text: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(text, F.lit(""))


def normalize_line_breaks(text: Column) -> Column:
    """Three or more line ends become one blank line."""
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def dehyphenate(text: Column) -> Column:
    """Joins a word cut by a hyphen at a line end."""
    return F.regexp_replace(text, r"(?U)(\w)-\n\s*(\w)", "$1$2")


def norm_line(line: Column) -> Column:
    """A line for recurrence comparison: stripped, digit runs as ``#``."""
    return F.regexp_replace(strip(line), r"\p{Nd}+", "#")


def is_protected_line(line: Column) -> Column:
    """Whether a line belongs to a figure, table or caption and can't be page chrome."""
    bare = strip(line)
    return (
        F.contains(bare, F.lit(K.TOKEN_HEAD)) | bare.rlike(HEADER_LINE) | bare.startswith("> ") | bare.startswith("![")
        | bare.startswith("|") | bare.startswith("Figure ") | F.lower(bare).startswith("<center>figure ")
    )


def strip_tokens(text: Column) -> Column:
    return strip(F.regexp_replace(text, K.ANY_TOKEN, ""))


def token_of(fig_id: Column) -> Column:
    return F.concat(F.lit(K.TOKEN_HEAD), fig_id, F.lit(K.TOKEN_TAIL))


def ensure_tokens(text: Column, fig_ids: Column) -> Column:
    """Appends the token of each figure that the text doesn't hold yet, in order."""

    def step(acc: Column, fig: Column) -> Column:
        token = token_of(fig)
        return F.when(F.contains(acc, token), acc).when(strip(acc) == "", token).otherwise(F.concat(rstrip(acc), F.lit("\n\n"), token))

    return F.aggregate(fig_ids, text, step)


def format_blockquote(description: Column, header: str = K.DESC_HEADER) -> Column:
    """A description as a block quote with a bold header in its first line."""
    return F.array_join(
        F.transform(F.split(strip(description), "\n"), lambda line, i: F.when(strip(line) == "", F.lit(">")).when(i == 0, F.concat(F.lit(f"> **{header}** "), line)).otherwise(F.concat(F.lit("> "), line))), "\n"
    )


def figure_block(fig_id: Column, description: Column, caption: Column, crop_path: Column, mode: str = "describe-only") -> Column:
    """What replaces a figure's token: description, image link and description, or a placeholder."""
    if mode == "placeholder":
        return F.lit(K.PLACEHOLDER_BLOCK)
    block = F.concat(format_blockquote(F.coalesce(present(description), F.lit(K.UNAVAILABLE))), F.lit("\n"))
    if mode == "describe-only":
        return block
    if mode != "describe-and-keep":
        raise ValueError(f"unknown figure mode: {mode}")
    alt = F.replace(F.replace(F.coalesce(present(caption), fig_id), F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))
    return F.when(present(crop_path).isNotNull(), F.concat(F.lit("!["), alt, F.lit("]("), crop_path, F.lit(")\n\n"), block)).otherwise(block)


def description_spacing(text: Column) -> Column:
    """Blank lines around description blocks and the figure captions that follow them: a walk over lines that knows whether it is in a block, whether
    it is after one, and the line written last (null before the first)."""
    lines = F.split(text, "\n")
    state = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("after"), F.lit(None).cast("string").alias("last"))
    empty, blank = F.array().cast("array<string>"), F.lit("")

    def step(now: Column, pair: Column) -> Column:
        line, coming = pair["line"], pair["coming"]
        inside, after, last = now["inside"], now["after"], now["last"]
        header, caption = line.rlike(HEADER_LINE), line.startswith("Figure ")
        parted = F.when(last.isNotNull() & (last != ""), F.array(blank, line)).otherwise(F.array(line))
        new = lambda out, i, a: F.struct(F.struct(i.alias("inside"), a.alias("after"), F.coalesce(F.element_at(F.concat(F.array(last), out), -1), last).alias("last")).alias("state"), out.alias("out"))
        return (
            F.when(~inside & header, new(parted, F.lit(True), F.lit(False)))
            .when(inside & line.startswith(">"), new(F.array(line), inside, after))
            .when(inside, new(F.when(line != "", F.array(blank, line)).otherwise(empty), F.lit(False), F.lit(True)))
            .when(after & caption, new(F.concat(parted, F.when(coming.isNotNull() & (coming != ""), F.array(blank)).otherwise(empty)), inside, after))
            .otherwise(new(F.array(line), inside, after & ((line == "") | caption)))
        )

    pairs = F.arrays_zip(lines.alias("line"), F.concat(F.slice(lines, 2, F.size(lines)), F.array(F.lit(None).cast("string"))).alias("coming"))
    done = let(walk(pairs, state, step, "string"), lambda w: F.array_join(F.when(w["state"]["inside"], F.array_append(w["out"], blank)).otherwise(w["out"]), "\n"))
    return F.when(F.contains(text, F.lit("> **Image")), done).otherwise(text)


def notice(text: Column, vlm_tables: Column | bool = False) -> Column:
    """The caveat sentence: what the document holds, and by what it was read."""
    vlm_tables = vlm_tables if isinstance(vlm_tables, Column) else F.lit(vlm_tables)
    flags = F.struct(
        text.rlike(r"\\\(|\\\[|\$\$").alias("equations"), (text.rlike(r"(?i)</?table\b|</?tr\b|</?td\b|</?th\b") | text.rlike(r"(?md)^\s*\|.+\|\s*\n\s*\|(?:\s*:?-{3,}:?\s*\|)+")).alias("tables"),
        text.rlike(r"(?md)^> \*\*Image description\.\*\*").alias("figures"), vlm_tables.alias("vlm"),
    )

    def sentence(f: Column) -> Column:
        items = F.array_compact(F.array(F.lit("text"), F.when(f["equations"], "equations"), F.when(f["tables"], "tables"), F.when(f["figures"], "figure descriptions")))
        source = F.when(f["figures"] | (f["vlm"] & f["tables"]), "OCR and VLMs").otherwise("OCR")
        return F.concat(F.lit("*Transcribed with "), source, F.lit("; "), let(items, _listed), F.lit(" may contain mistakes.*"))

    return let(flags, sentence)


def _listed(items: Column) -> Column:
    last = F.element_at(items, -1)
    return F.when(F.size(items) == 1, last).when(F.size(items) == 2, F.array_join(items, " and ")).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), F.size(items) - 1), ", "), F.lit(", and "), last))


def append_notice(text: Column, vlm_tables: Column | bool = False) -> Column:
    return F.concat(rstrip(text), F.lit("\n\n---\n\n"), notice(text, vlm_tables), F.lit("\n"))


def truncated(text: Column, cap: int) -> Column:
    """A text of more than ``cap`` code points cut to end in three dots within it; a cap of 0 cuts nothing."""
    return F.when(F.length(text) > cap, F.concat(F.substring(text, 1, max(0, cap - 3)), F.lit("..."))).otherwise(text) if cap > 0 else text


def page_context(page_number: Column, page_text: Column, cap: int = K.CONTEXT_CHARS) -> Column:
    return F.concat(F.lit("This image appears on page "), page_number.cast("string"), F.lit(". The surrounding page content follows.\n\n"), truncated(page_text, cap))


def fill(template: str, **holes: Column) -> Column:
    """Fills the ``{name}`` holes of a template; texts with braces are safe, as the template is cut at its holes once."""
    parts, rest = [], template
    while rest:
        found = min(((rest.find("{" + n + "}"), n) for n in holes if "{" + n + "}" in rest), default=None)
        if found is None:
            parts.append(F.lit(rest))
            break
        at, name = found
        parts += [F.lit(rest[:at]), F.coalesce(holes[name], F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def description_from_tags(response: Column) -> Column:
    """What stands between the description tags; all that follows an unclosed one; the whole response where there is none."""
    bare, head, tail = strip(F.coalesce(response, F.lit(""))), "<img_desc>", "</img_desc>"
    rest = F.substring_index(F.concat(F.lit("\u0001"), bare), head, 1)
    after = F.substring(bare, F.length(rest) + len(head), F.length(bare))
    return F.when(F.contains(bare, F.lit(head)), strip(F.substring_index(after, tail, 1))).otherwise(bare)


def mark_truncated(description: Column, was_cut: Column) -> Column:
    """Adds `` [...]`` to a description that was cut off, once."""
    return F.when(was_cut & ~description.endswith("[...]"), F.concat(description, F.lit(" [...]"))).otherwise(description)


def was_truncated(finish_reason: Column) -> Column:
    return F.coalesce(finish_reason != "stop", F.lit(False))


def build_number(version: Column) -> Column:
    """The build in a server's version text (``version: 9587`` or ``b9587``), null where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(version, r"version:\s*(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(version, r"\Ab(\d+)\b", 1), F.lit(""))).cast("int")


def bundle_name(base: Column) -> Column:
    """The folder of a document's page bundle."""
    return F.concat(base, F.lit(".pages"))


def base_name(name: Column) -> Column:
    """A safe output stem."""
    safe = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{M}\p{N}_\-]+", "_"), r"\A_+|_+\z", "")
    return F.when(safe == "", F.lit("paper")).when(safe.rlike(r"(?i)\A(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])\z"), F.concat(safe, F.lit("_"))).otherwise(safe)


def page_numbers(spec: Column, total: Column) -> Column:
    """The pages that a range such as ``2-5``, ``3-``, ``-4``, ``7`` or ``all`` selects of ``total``; a bad range is an error."""
    bare = F.lower(strip(F.coalesce(spec, F.lit(""))))
    low = F.nullif(F.regexp_extract(bare, r"\A(\d*)\s*-\s*\d*\z|\A(\d+)\z", 1), F.lit(""))
    one = F.nullif(F.regexp_extract(bare, r"\A(\d+)\z", 1), F.lit(""))
    high = F.nullif(F.regexp_extract(bare, r"\A\d*\s*-\s*(\d*)\z", 1), F.lit(""))
    start = F.coalesce(one, low, F.lit("1")).cast("bigint")
    stop = F.coalesce(one, high, total.cast("string")).cast("bigint")
    whole = bare.isin("", "all")
    a, b = F.when(whole, F.lit(1)).otherwise(start), F.least(F.when(whole, total).otherwise(stop), total)
    valid = whole | (bare.rlike(r"\A(\d+|\d+\s*-\s*\d*|-\s*\d+)\z") & (start >= 1) & (stop >= 1))
    empty = F.array().cast("array<bigint>")
    return F.when(total <= 0, empty).when(~valid, F.raise_error(F.concat(F.lit("bad page range: "), spec)).cast("array<bigint>")).when(a > b, empty).otherwise(F.sequence(a.cast("bigint"), b.cast("bigint")))
