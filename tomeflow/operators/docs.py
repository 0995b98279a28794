"""Documentation text jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomeflow.core import discard, materialize
from tomeflow.functions.strings import collapse_whitespace, reindent, strip

# Comment commands and the doc section each starts.
COMMANDS = {
    "brief": "brief", "short": "brief", "return": "returns", "returns": "returns", "result": "returns", "throw": "exceptions", "throws": "exceptions", "exception": "exceptions",
    "note": "note", "warning": "warning", "par": "par", "li": "li", "details": "details", "see": "sees", "sa": "sees", "pre": "pre", "post": "post", "param": "params", "tparam": "tparams",
    "ref": "ref", "copybrief": "copybrief", "copydetails": "copydetails", "copydoc": "copydoc", "relates": "relates", "related": "relates", "relatesalso": "relates", "memberof": "relates",
}


def comment_texts(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, pos, body): '/** */' comments and runs of '///' lines of source files,
    without their markers."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?s)(/\*\*.*?\*/|(?m:^[ \t]*///[^\n]*(?:\n[ \t]*///[^\n]*)*))"), 1)
    raw = files.select(path, F.posexplode(found).alias("pos", "raw"))
    inner = F.regexp_replace("raw", r"^\s*/\*\*+<?|\*+/$", "")
    lines = F.regexp_replace(inner, r"(?m)^[ \t]*(///<?|\*)[ \t]?", "")
    return raw.select(path, "pos", F.trim(lines).alias("body"))


def doc_commands(comments: DataFrame, key: list[str], body: str = "body") -> DataFrame:
    """(key, pos, command, section, argument, direction, literal): a comment is
    cut before each known command at a line's start; text before the first command
    is a paragraph. Commands with a name take the first word as argument."""
    names = "|".join(sorted(COMMANDS, key=len, reverse=True))
    parts = F.split(F.col(body), rf"(?m)^[ \t]*(?=[@\\](?:{names})\b)")
    each = comments.select(*key, F.posexplode(parts).alias("pos", "part")).where("trim(part) <> ''")
    command = F.regexp_extract("part", rf"^\s*[@\\]({names})\b", 1)
    section = F.try_element_at(F.create_map(*[F.lit(x) for kv in COMMANDS.items() for x in kv]), command)
    head = rf"(?s)^\s*[@\\](?:{names})\b(?:\s*\[([^\]]*)\])?[ \t]*"
    rest = strip(F.regexp_replace("part", head, ""))
    named = section.isin("params", "tparams", "exceptions", "relates", "copybrief", "copydetails", "copydoc", "ref")
    argument = F.when(named, F.regexp_extract(rest, r"^([^\s,]+(?:\s*,\s*[^\s,]+)*)", 1))
    literal = F.when(named, strip(F.regexp_replace(rest, r"^[^\s,]+(?:\s*,\s*[^\s,]+)*\s*", ""))).otherwise(rest)
    spec = F.regexp_replace(F.lower(F.regexp_extract("part", head, 1)), r"[\s,]+", "")
    direction = F.when(section == "params", F.when(spec.isin("inout", "outin"), "inout").when(spec == "in", "in").when(spec == "out", "out").otherwise("none"))
    return each.select(*key, "pos", F.when(command == "", None).otherwise(command).alias("command"), F.coalesce(section, F.lit("paragraph")).alias("section"), argument.alias("argument"), direction.alias("direction"), collapse_whitespace(literal).alias("literal"))


def param_rows(commands: DataFrame, key: list[str]) -> DataFrame:
    """One row per name of a comma-separated parameter argument."""
    rows = commands.where("section = 'params'")
    return rows.select(*key, "pos", F.explode(F.split("argument", ",")).alias("name"), "direction", "literal").withColumn("name", F.trim("name"))


# Span kinds and the delimiters around them.
SPANS = {"strong": r"\*\*", "strong-underline": "__", "strike": "~~", "mark": "==", "math": r"\$\$"}
# Single-character delimiters, which must hug their text.
TIGHT = {"emph": r"\*", "emph-underline": "_", "code": "`", "superscript": r"\^", "subscript": "~", "inline-math": r"\$"}
# Inline tags.
TAGS = ["em", "strong", "code", "sup", "sub", "del", "mark"]


def inline_spans(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """D3: (key, kind, pos, literal, href): non-nested spans of each kind, links and
    images. A delimiter opens before a non-space and closes after one; a single
    underscore does neither within a word."""
    c = F.col(text)
    spans = []
    for kind, d in SPANS.items():
        spans.append((kind, rf"(?s)(?<!\\){d}(?=\S)((?:(?!{d}).)+?)(?<=\S){d}"))
    for kind, d in TIGHT.items():
        edge = (r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])") if kind == "emph-underline" else (rf"(?<![\\{d[-1]}])", rf"(?!{d})")
        spans.append((kind, rf"{edge[0]}{d}(?!{d})(?=\S)([^{d}\n]+?)(?<=\S){d}{edge[1]}"))
    for tag in TAGS:
        spans.append((tag, rf"(?s)<{tag}>(.*?)</{tag}>"))
    rows = [F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(c, F.lit(r), 1).alias("found")) for k, r in spans]
    each = df.select(*key, F.explode(F.array(*rows)).alias("s")).select(*key, F.col("s.kind").alias("kind"), F.posexplode("s.found").alias("pos", "literal")).withColumn("href", F.lit(None).cast("string"))
    link = r"(?<!!)\[([^\]]*)\]\(([^)\s]*)\)"
    image = r"!\[([^\]]*)\]\(([^)\s]*)\)"
    anchor = r"(?s)<a\s+href=\"([^\"]*)\"[^>]*>(.*?)</a>"
    for kind, r, text_group, href_group in (("link", link, 1, 2), ("image", image, 1, 2), ("link-tag", anchor, 2, 1)):
        both = F.arrays_zip(F.regexp_extract_all(c, F.lit(r), text_group).alias("t"), F.regexp_extract_all(c, F.lit(r), href_group).alias("h"))
        got = df.select(*key, F.posexplode(both).alias("pos", "z"))
        each = each.unionByName(got.select(*key, F.lit(kind).alias("kind"), "pos", F.col("z")["t"].alias("literal"), F.col("z")["h"].alias("href")))
    return each


def merge_siblings(df: DataFrame, keys: list[str], order: list[str], kind: str, literal: str, single: list[str] = ["link", "image", "line-break", "soft-break"], sep: str = "") -> DataFrame:
    """Neighbours of one kind become one row (keys, kind, island, n, literal);
    ``single`` kinds stay apart. Islands come from one window pass."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.coalesce((F.lag(kind).over(w) != F.col(kind)) | F.col(kind).isin(single), F.lit(True))
    marked = df.withColumn("__new", new.cast("int")).withColumn("island", F.sum("__new").over(w) - 1)
    parts = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(literal, F.lit("")).alias("__t"))))
    return marked.groupBy(*keys, "island", kind).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(parts, lambda p: p["__t"]), sep).alias(literal))


def tidy(blocks: DataFrame, kind: str = "kind", literal: str = "literal") -> DataFrame:
    """Without leftover copy commands and empty blocks; texts trimmed and
    collapsed; code unindented."""
    c = F.col(literal)
    text = F.when(F.col(kind) == "code", reindent(c, 0)).otherwise(collapse_whitespace(F.trim(c)))
    out = blocks.where(~F.col(kind).isin("copybrief", "copydetails", "copydoc")).withColumn(literal, text)
    return out.where((F.trim(literal) != "") & F.col(literal).isNotNull())


def split_brief(blocks: DataFrame, key: str, pos: str = "pos", kind: str = "kind", literal: str = "literal") -> tuple[DataFrame, DataFrame]:
    """(first non-blank paragraph per key as its brief, the other blocks)."""
    usable = (F.col(kind) == "paragraph") & (F.trim(literal) != "")
    w = Window.partitionBy(key).orderBy(F.when(usable, 0).otherwise(1), pos)
    ranked = blocks.withColumn("__r", F.row_number().over(w)).withColumn("__brief", usable & (F.col("__r") == 1))
    return ranked.where("__brief").drop("__r", "__brief"), ranked.where("not __brief").drop("__r", "__brief")


def copy_docs(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """(id, text, source, depth): texts of symbols that have none but copy
    another's (``copies``: id, target_id; of several targets the least), through
    chains of any length, by pointer doubling; only ids travel. Cycles, and chains
    that end in a symbol without text, resolve to nothing. ``docs``: id, text."""
    have = docs.where("text is not null and text <> ''").select("id", "text")
    pending = copies.join(have.select("id"), "id", "left_anti").groupBy("id").agg(F.min("target_id").alias("at")).where("at is not null")
    cur = materialize(pending.select("id", "at", F.lit(1).cast("long").alias("depth")), "copies")
    reach, links = 1, cur.count()
    while reach <= links:  # a chain is no longer than there are links
        nxt = cur.select(F.col("id").alias("__i"), F.col("at").alias("__at"), F.col("depth").alias("__d"))
        moved = cur.join(nxt, F.col("at") == F.col("__i"), "left").select("id", F.coalesce("__at", "at").alias("at"), (F.col("depth") + F.coalesce("__d", F.lit(0))).alias("depth"), F.col("__i").isNotNull().alias("more"))
        last, cur = cur, materialize(moved, "copies")
        discard(last)
        if cur.where("more").isEmpty():
            break
        reach *= 2
    ends = cur.select("id", "at", F.col("depth").cast("int").alias("depth"))
    copied = ends.join(have.select(F.col("id").alias("source"), "text"), F.col("at") == F.col("source")).select("id", "text", "source", "depth")
    return have.select("id", "text", F.col("id").alias("source"), F.lit(0).alias("depth")).union(copied)


def brief_of_type(params: DataFrame, briefs: DataFrame, type_col: str = "inner_type_id") -> DataFrame:
    """``doc`` of parameters (or returns) without one, from their type's brief."""
    b = briefs.select(F.col("id").alias("__b"), F.col("brief").alias("__brief"))
    return params.join(b, F.col(type_col) == F.col("__b"), "left").withColumn("doc", F.coalesce(F.when(F.col("doc") != "", F.col("doc")), "__brief")).drop("__b", "__brief")


# Operators that can have one operand, and two.
UNARY = ["+", "-", "*", "&", "~", "!", "++", "--", " new", " delete", " new[]", " delete[]", " co_await"]
BINARY = [
    "+", "-", "*", "/", "%", "^", "&", "|", "<<", ">>", "=", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<=", ">>=",
    "==", "!=", "<", "<=", ">", ">=", "<=>", "&&", "||", "->*", "->", "()", "[]", ",",
]
# What a comparison returns true for.
COMPARISONS = {
    "==": "the objects are equal", "!=": "the objects are not equal", "<": "the left object is less than the right object",
    "<=": "the left object is less than or equal to the right object", ">": "the left object is greater than the right object",
    ">=": "the left object is greater than or equal to the right object", "!": "the object is falsy",
}
# How a brief that says what is returned begins.
RETURN_PREFIXES = ["Returns ", "Return ", "Get ", "Gets ", "Determine ", "Determines "]


def _is(operators: list[str]) -> Column:
    return F.coalesce(F.col("operator"), F.lit("")).isin(["operator" + o for o in operators])


def auto_brief() -> Column:
    """Brief of a special function or operator, over func_class, is_default,
    is_copy, is_move, param_count, param_type (innermost name of the first parameter),
    return_type (innermost name), is_stream, is_copy_assign, is_move_assign and
    readable_name (operator)."""
    ctor = F.col("func_class") == "constructor"
    return (
        F.when(ctor & F.col("is_default"), F.lit("Default constructor"))
        .when(ctor & F.col("is_copy"), F.lit("Copy constructor"))
        .when(ctor & F.col("is_move"), F.lit("Move constructor"))
        .when(ctor & (F.col("param_count") == 1) & (F.col("param_type") != ""), F.concat(F.lit("Construct from "), "param_type"))
        .when(ctor, F.lit("Constructor"))
        .when(F.col("func_class") == "destructor", F.lit("Destructor"))
        .when((F.col("func_class") == "conversion") & (F.col("return_type") != ""), F.concat(F.lit("Conversion to "), "return_type"))
        .when(F.col("func_class") == "conversion", F.lit("Conversion operator"))
        .when(F.col("is_stream"), F.lit("Stream insertion operator"))
        .when(F.col("is_copy_assign"), F.lit("Copy assignment operator"))
        .when(F.col("is_move_assign"), F.lit("Move assignment operator"))
        .when(F.col("readable_name").isNotNull(), F.concat("readable_name", F.lit(" operator")))
    )


def returns_from_brief(brief: Column) -> Column:
    """The returned thing, from a plain brief that begins with a verb of
    ``RETURN_PREFIXES``: what follows it, as it is."""
    cut = [F.when(F.startswith(brief, F.lit(p)), F.substring(brief, len(p) + 1, 1 << 30)) for p in RETURN_PREFIXES]
    return F.coalesce(*cut)


def auto_returns() -> Column:
    """What a special function returns, over func_class, operator, is_stream,
    is_record_method, parent_id, return_kind (named, lref, rref, pointer),
    return_symbol, return_type (innermost name), return_fundamental and return_brief
    (of the innermost type)."""
    own = F.coalesce(F.col("return_symbol") == F.col("parent_id"), F.lit(False))
    kind = F.col("return_kind")
    truth = F.coalesce(*[F.when(_is([o]), F.lit(f"true if {t}, false otherwise")) for o, t in COMPARISONS.items()])
    return (
        F.when(F.col("func_class") == "conversion", F.coalesce("return_brief", F.concat(F.lit("The object converted to "), "return_type")))
        .when(F.coalesce("operator", F.lit("")) == "", None)
        .when(F.col("is_stream"), F.lit("Reference to the current output stream"))
        .when(kind == "lref", F.when(own, F.lit("Reference to the current object")))
        .when(kind == "pointer", F.when(own, F.lit("Pointer to the current object")))
        .when(_is(list(COMPARISONS)), F.when((kind == "named") & (F.col("return_fundamental") == "bool"), truth))
        .when(_is(["<=>"]), F.lit("The relative order of the objects"))
        .when(F.col("is_record_method") & own, F.when(kind == "rref", F.lit("Rvalue reference to the current object")).otherwise(F.lit("Another instance of the object")))
    )


def _operands() -> dict[str, Column]:
    """Where a parameter of a function's row stands: name -> condition."""
    pos, count, method = F.col("pos"), F.col("param_count"), F.col("is_record_method")
    first, free = pos == 0, count + method.cast("int")
    made = (F.col("func_class") == "constructor") | _is(["="])
    return {
        "made": first & method & made, "stream": (pos < 2) & F.col("is_stream"),
        "binary": (pos + method.cast("int") < 2) & _is(BINARY) & (free == 2), "unary": first & ~method & _is(UNARY) & (count == 1),
    }


def auto_param_name() -> Column:
    """Name of a parameter without one, over pos, name, names (the names that the
    function has), param_count, func_class, operator, is_stream, is_record_method,
    param_symbol and parent_id; null if no rule applies or the name is taken."""
    at, left = _operands(), F.col("pos") + F.col("is_record_method").cast("int") == 0
    other = F.coalesce(F.col("param_symbol") == F.col("parent_id"), F.lit(False))
    free = lambda when, name: F.when(when & ~F.array_contains("names", name), name)
    return F.coalesce(
        F.when(F.col("name") != "", F.col("name")),
        free(at["made"] & (F.col("param_count") == 1), F.when(other, "other").otherwise("value")),
        free(at["stream"], F.when(F.col("pos") == 0, "os").otherwise("value")),
        free(at["binary"], F.when(left, "lhs").otherwise("rhs")), free(at["unary"], F.lit("value")),
    )


def auto_param_doc() -> Column:
    """Text of an undocumented parameter, over the columns of ``auto_param_name``,
    param_kind (named, lref, rref, pointer), is_fundamental (its innermost type) and
    type_brief (of the innermost type, J21)."""
    at, left = _operands(), F.col("pos") + F.col("is_record_method").cast("int") == 0
    plain = F.col("is_fundamental")
    verb = F.when(_is(["="]), "assign").otherwise("construct")
    how = F.when(plain, "").when(F.col("param_kind") == "lref", "copy ").when(F.col("param_kind") == "rref", "move ").otherwise("")
    return (
        F.when(at["made"], F.concat(F.lit("The "), F.when(plain, "value").otherwise("object"), F.lit(" to "), how, verb, F.lit(" from")))
        .when(at["stream"], F.when(F.col("pos") == 0, "An output stream").otherwise("The object to output"))
        .when(at["binary"], F.when(left, "The left operand").otherwise("The right operand"))
        .when(at["unary"], F.lit("The operand"))
        .otherwise(F.col("type_brief"))
    )


def _fields(array: Column, names: list[str]) -> Column:
    return F.transform(array, lambda x: F.struct(*[x[n].alias(n) for n in names]))


def page_sections(symbols: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """One column of ordered structs per section (DataFrames symbol_id, pos, name,
    url, brief); null where a symbol has none. All sections are gathered in one
    aggregation."""
    cols = {name: [c for c in rows.columns if c not in ("symbol_id", "pos")] for name, rows in sections.items()}
    tagged = [rows.select(F.col("symbol_id").alias("__s"), F.lit(name).alias("__section"), F.struct("pos", *cols[name]).alias(name)) for name, rows in sections.items()]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    found = every.groupBy("__s").agg(*[F.array_sort(F.collect_list(name)).alias(name) for name in sections])
    listed = found.select("__s", *[F.when(F.size(name) > 0, _fields(F.col(name), cols[name])).alias(name) for name in sections])
    return symbols.join(listed, F.col("id") == F.col("__s"), "left").drop("__s")


def render_pages(symbols: DataFrame, title: Column, parts: list[Column]) -> DataFrame:
    """``page`` of every row, a concatenation of column expressions (null parts
    are absent)."""
    return symbols.withColumn("page", F.concat(title, *[F.coalesce(p, F.lit("")) for p in parts]))
