"""Facts from lines of text: regular expressions as expressions, many facts of a line by explode."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factforge.sources.tables import blocks

CLAUSE = "[;\n]"


def page_text(blocks: DataFrame, most: int = 12_000) -> DataFrame:
    """A page's blocks in order as one text, at most so many characters, with confidence .74 at most."""
    grouped = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("all"))
    return grouped.select("doc_id", F.left(F.array_join("all.text", "\n"), F.lit(most)).alias("text"), F.lit(0.74).alias("confidence"))


NUMBER = r"\s*[:：]?\s*(\d+(?:\.\d+)?)"
ROUND = r"\s*[:：]?\s*[φΦØø]?\s*(\d+(?:\.\d+)?)"
# Labels of numbers with unit and confidence, in order of precedence; letters of either case.
LABELED = (
    ("wire_diameter", r"(?:线径|线经|WIRE\s*DIA|WIRE|wire)" + ROUND, "mm", 0.82),
    ("outer_diameter", r"(?:外径|外徑|OD|O\.D\.)" + ROUND, "mm", 0.8),
    ("inner_diameter", r"(?:内径|內徑|ID|I\.D\.)" + ROUND, "mm", 0.8),
    ("mean_diameter", r"(?:中径|中徑|平均径|MEAN\s*DIA)" + ROUND, "mm", 0.8),
    ("free_length", r"(?:自由长|自由长度|自由長度|FREE\s*LENGTH|L0|Lf)" + NUMBER, "mm", 0.8),
    ("body_length", r"(?:弹体长|弹体长度|BODY\s*LENGTH)" + NUMBER, "mm", 0.72),
    ("solid_height", r"(?:压并高度|壓並高度|压缩高度|SOLID\s*HEIGHT)" + NUMBER, "mm", 0.72),
    ("total_coils", r"(?:总圈数|總圈數|圈数|圈數|TOTAL\s*COILS)" + NUMBER, "turns", 0.82),
    ("active_coils", r"(?:有效圈数|有效圈數|ACTIVE\s*COILS)" + NUMBER, "turns", 0.78),
    ("end_coils", r"(?:端圈数|端圈數|END\s*COILS)" + NUMBER, "turns", 0.72),
    ("support_coils", r"(?:支承圈数|支承圈數|SUPPORT\s*COILS)" + NUMBER, "turns", 0.72),
    ("pitch", r"(?:节距|節距|PITCH)" + NUMBER, "mm", 0.78),
    ("spring_rate", r"(?:刚度|剛度|弹簧刚度|SPRING\s*RATE|RATE)" + NUMBER, "N/mm", 0.76),
    ("perpendicularity", r"(?:垂直度|PERPENDICULARITY)" + NUMBER, "mm", 0.72),
    ("straightness", r"(?:直线度|直線度|STRAIGHTNESS)" + NUMBER, "mm", 0.72),
    ("permanent_set_limit", r"(?:永久变形|永久變形)\s*(?:≤|<=|小于|不大于)?\s*(\d+(?:\.\d+)?)", "mm", 0.7),
    ("arm_length", r"(?:臂长|臂長|ARM\s*LENGTH)" + NUMBER, "mm", 0.72),
    ("free_angle", r"(?:自由角|FREE\s*ANGLE)" + NUMBER, "deg", 0.72),
    ("working_angle", r"(?:工作角|WORKING\s*ANGLE)" + NUMBER, "deg", 0.72),
    ("opening_width", r"(?:开口|開口|OPENING)" + NUMBER, "mm", 0.7),
    ("gap_width", r"(?:缺口宽|缺口寬|缺口|GAP)" + NUMBER, "mm", 0.7),
    ("thickness", r"(?:厚度|板厚|THICKNESS)" + NUMBER, "mm", 0.72),
)
#: Of each of these patterns, what any match holds one of, in lower case: looked for before the pattern is.
HELD = dict(zip((r[1] for r in LABELED), (
    ("线径", "线经", "wire"), ("外径", "外徑", "od", "o.d."), ("内径", "內徑", "id", "i.d."), ("中径", "中徑", "平均径", "mean"), ("自由长", "自由長", "free", "l0", "lf"),
    ("弹体长", "body"), ("压并高度", "壓並高度", "压缩高度", "solid"), ("圈数", "圈數", "total"), ("有效圈", "active"), ("端圈", "end"), ("支承圈", "support"), ("节距", "節距", "pitch"),
    ("刚度", "剛度", "rate"), ("垂直度", "perpendicularity"), ("直线度", "直線度", "straightness"), ("永久变形", "永久變形"), ("臂长", "臂長", "arm"), ("自由角", "free"), ("工作角", "working"),
    ("开口", "開口", "opening"), ("缺口", "gap"), ("厚度", "板厚", "thickness"),
), strict=True))
GRADE = r"\s*(?:精度等级|精度|等级)\s*[:：]?\s*([Tt123])\s*级?"
COLD, HOT = r"GB\s*/?\s*T\s*1239\.?2\s*[-—－]?\s*2009", r"GB\s*/?\s*T\s*23934\s*[-—－]?\s*(?:2014|2015)"
# Feature, pattern, value (None: the group and the word for grade, or the match itself), confidence, pattern that must be absent.
CONTEXT = (
    ("standard_no", COLD, "GB/T 1239.2-2009", 0.86, None),
    ("manufacturing_method", COLD, "cold_coiled", 0.82, None),
    ("standard_no", HOT, "GB/T 23934-2015", 0.86, None),
    ("manufacturing_method", HOT, "hot_coiled", 0.82, None),
    ("spring_family", r"(圆柱螺旋|圆柱\s*压缩|cylindrical\s+compression)", "helical", 0.72, None),
    ("spring_shape", r"(圆柱螺旋|圆柱\s*压缩|cylindrical\s+compression)", "cylindrical", 0.72, None),
    ("manufacturing_method", r"(冷卷|冷绕|冷成形|cold\s*(?:coiled|formed|wound))", "cold_coiled", 0.78, None),
    ("manufacturing_method", r"(热卷|热绕|热成形|hot\s*(?:coiled|formed|wound))", "hot_coiled", 0.78, None),
    ("spring_shape", r"(圆锥|锥形|conical)", "conical", 0.78, None),
    ("spring_shape", r"(鼓形|腰鼓|barrel|hourglass)", "barrel", 0.74, None),
    ("wire_section", r"(矩形截面|方形截面|模具弹簧|rectangular\s*(?:wire|section))", "rectangular", 0.78, None),
    ("pitch_type", r"(变节距|不等节距|variable\s*pitch)", "variable", 0.78, None),
    ("accuracy_grade", r"(?:精度等级|精度|等级|級别|级别)\s*[:：]?\s*([Tt123])\s*级?", None, 0.76, None),
    ("diameter_accuracy_grade", r"(?:直径|外径|内径|中径)" + GRADE, None, 0.78, None),
    ("free_length_accuracy_grade", r"(?:自由长|自由长度|自由高度|H0)" + GRADE, None, 0.78, None),
    ("load_accuracy_grade", r"(?:负荷|载荷|力值|负载)" + GRADE, None, 0.78, None),
    ("stiffness_accuracy_grade", r"(?:刚度|剛度)" + GRADE, None, 0.78, None),
    ("controlled_diameter_field", r"外径\s*(?:控制|受控)", "outer_diameter", 0.74, None),
    ("controlled_diameter_field", r"内径\s*(?:控制|受控)", "inner_diameter", 0.74, r"外径\s*(?:控制|受控)"),
)


def labeled_numbers(texts: DataFrame, keys: list[str], rules: tuple[tuple[str, str, str, float], ...] = LABELED) -> DataFrame:
    """keys, field, value, unit, confidence: the first match of each rule (field, pattern with one group, unit, confidence). A pattern is matched
    against texts that hold one of its words; one that HELD doesn't have, against all."""

    def value(pattern: str) -> Column:
        number = F.regexp_extract("text", f"(?i){pattern}", 1).try_cast("double")
        return F.when(reduce(or_, (F.contains(F.col("_low"), F.lit(w)) for w in HELD[pattern])), number) if pattern in HELD else number

    found = F.array(*(F.struct(F.lit(f).alias("field"), value(p).alias("value"), F.lit(u).alias("unit"), F.lit(c).alias("confidence")) for f, p, u, c in rules))
    return texts.withColumn("_low", F.lower("text")).select(*keys, F.inline(F.filter(found, lambda x: x["value"].isNotNull())))


def context_features(texts: DataFrame, keys: list[str], rules: tuple[tuple[str, str, str | None, float, str | None], ...] = CONTEXT) -> DataFrame:
    """keys, feature, value, confidence of each rule whose pattern the text has, and not the one that must be absent."""

    def one(feature: str, pattern: str, value: str | None, confidence: float, absent: str | None) -> Column:
        text = F.lit(value) if value is not None else F.concat(F.regexp_extract("text", f"(?i){pattern}", 1), F.lit("级"))
        hit = F.col("text").rlike(f"(?i){pattern}") if absent is None else F.col("text").rlike(f"(?i){pattern}") & ~F.col("text").rlike(f"(?i){absent}")
        return F.when(hit, F.struct(F.lit(feature).alias("feature"), text.alias("value"), F.lit(confidence).alias("confidence")))

    return texts.select(*keys, F.inline(F.array_compact(F.array(*(one(*r) for r in rules)))))


def keyword_features(notes: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(doc_id, line_no, feature, value) of each rule (feature, pattern, value) whose pattern the text has."""
    found = F.array(*(F.when(F.col("text").rlike(p), F.struct(F.lit(f).alias("feature"), F.lit(v).alias("value"))) for f, p, v in rules))
    return notes.select("doc_id", "line_no", "l_partkey", "l_suppkey", F.inline(F.array_compact(found)))


def value_tolerance(text: Column, label: str) -> Column:
    """struct(value, upper, lower) of `label v +/-t` or `label v 0/-t`."""
    symmetric, below = rf"{label} ([0-9.]+) \+/-([0-9.]+)", rf"{label} ([0-9.]+) 0/-([0-9.]+)"
    one = lambda p, g: F.regexp_extract(text, p, g).cast("double")
    return F.when(text.rlike(symmetric), F.struct(one(symmetric, 1).alias("value"), one(symmetric, 2).alias("upper"), (0 - one(symmetric, 2)).alias("lower"))).when(
        text.rlike(below), F.struct(one(below, 1).alias("value"), F.lit(0.0).alias("upper"), (0 - one(below, 2)).alias("lower"))
    )


# Units of a force as written, with the unit each stands for and its newtons; signs of a two-sided tolerance; units that
# make a number something else than a force: per length behind it, or a tolerance of another kind.
WRITTEN_UNITS = {"kn": ("kN", 1000.0), "kgf": ("kgf", 9.80665), "n": ("N", 1.0), "牛顿": ("N", 1.0), "牛": ("N", 1.0)}
PLUS_MINUS, PER_LENGTH, OTHER_UNITS = ("±", r"\+\s*/\s*-", "士"), ("mm", "cm", "m"), ("mm", "cm", "MPa", "kg")


def force_pattern() -> str:
    """label = force [unit] [tolerance] [unit or %] [what makes it no force]; groups 1 to 10 in the order of FORCE_PARTS."""
    number, unit = r"\d+(?:\.\d+)?", "|".join(WRITTEN_UNITS)
    label = r"(?<![A-Za-z0-9_])([A-Za-z0-9_\u4e00-\u9fff]{1,24})\s*(?:[=:]\s*|\s+)"
    force = rf"([+-]?{number})(?![\d.])\s*({unit})?\s*"
    both, apart, one = rf"(?:{'|'.join(PLUS_MINUS)})\s*([+-]?{number})", rf"(\+\s*{number})\s*({unit})?\s*/\s*(-\s*{number})", rf"([+-]\s*{number})"
    tail = rf"\s*(%|{unit})?(\s*[/·]\s*(?:{'|'.join(PER_LENGTH)})(?![A-Za-z])|(?:{'|'.join(OTHER_UNITS)})(?![A-Za-z]))?"
    return rf"(?i){label}{force}(?:{both}|{apart}|{one})?{tail}"


FORCE_PARTS = ("label", "force", "unit", "both", "up", "up_unit", "down", "one", "tail", "stop")


def force_annotations(notes: DataFrame, keys: list[str], declared_unit: str | None = None) -> DataFrame:
    """keys, label, force, unit, tol_upper, tol_lower, tol_percent (in the force's unit), state of each force with a label in a text:
    specified (two-sided, one-sided or in percent), not_specified, or uncertain (one-sided percentages, a negative two-sided one, or a
    tolerance in no unit of force). Numbers per length and numbers without any unit are no forces."""
    c = F.col
    # One pass over a text: each match becomes its groups between marks that no group holds, and the text around it falls away.
    text = F.translate("text", "＋−＝：\u0001\u0002", "+-=:\u0003\u0003")
    parts = "\u0001".join(f"${i}" for i in range(1, len(FORCE_PARTS) + 1))
    pieces = F.split(F.regexp_replace(text, F.lit(force_pattern()), F.lit(f"\u0002{parts}\u0002")), "\u0002", -1)
    found = notes.select(*keys, F.explode(F.transform(F.filter(pieces, lambda p, i: i % 2 == 1), lambda p: F.split(p, "\u0001", -1))).alias("_m"))
    found = found.select(*keys, *(c("_m")[i].alias(n) for i, n in enumerate(FORCE_PARTS)))
    number = lambda x: F.translate(x, " \t\n\u000b\f\r", "").try_cast("double")
    names = F.create_map(*(F.lit(x) for k, v in WRITTEN_UNITS.items() for x in (k, v[0])))
    newtons = F.create_map(*(F.lit(x) for k, v in WRITTEN_UNITS.items() for x in (k, v[1])))
    written = lambda x: F.nullif(F.lower(x), F.lit(""))
    # Steps of their own: what is used many times is computed once for a row.
    found = found.withColumns({"percent": c("tail") == "%", "f": number("force"), **{n: number(n) for n in ("both", "up", "down", "one")}, **{n: written(n) for n in ("unit", "up_unit", "tail")}})
    found = found.withColumn("last", F.when(~c("percent"), c("tail"))).withColumn("u", F.coalesce("unit", "last", F.lower(F.lit(declared_unit))))
    found = found.where(~c("stop").rlike("[/·]") & c("u").isNotNull() & (c("f") >= 0))
    percent, both, up, one = c("percent"), c("both"), c("up"), c("one")
    some = both.isNotNull() | up.isNotNull() | one.isNotNull()
    state = F.when(some & (c("stop") != ""), "uncertain").when(both < 0, "uncertain").when((up.isNotNull() | one.isNotNull()) & percent, "uncertain").when(some, "specified").otherwise("not_specified")
    ratio = lambda x: F.element_at(newtons, x) / F.element_at(newtons, c("u"))
    found = found.withColumns({"state": state, "at": ratio(F.coalesce("last", "u")), "up_at": ratio(F.coalesce("up_unit", "last", "u"))})
    upper = F.when(both.isNotNull() & ~percent, both * c("at")).when(up.isNotNull(), up * c("up_at")).when(one >= 0, one * c("at"))
    lower = F.when(both.isNotNull() & ~percent, 0 - both * c("at")).when(up.isNotNull(), c("down") * c("at")).when(one < 0, one * c("at"))
    sure = lambda x: F.when(c("state") == "specified", x)
    return found.select(*keys, "label", c("f").alias("force"), F.element_at(names, c("u")).alias("unit"), F.round(sure(upper), 12).alias("tol_upper"), F.round(sure(lower), 12).alias("tol_lower"), sure(F.when(percent, both)).alias("tol_percent"), "state")


def load_heights(notes: DataFrame) -> DataFrame:
    """Direct heights tied to a label, clause by clause; clauses on deflection don't count."""
    clause = notes.select("doc_id", "line_no", "l_partkey", "l_suppkey", F.explode(F.split("text", CLAUSE)).alias("clause")).where(~F.col("clause").rlike("deflection|stroke"))
    pairs = F.arrays_zip(F.regexp_extract_all("clause", F.lit("H([0-9]+)=([0-9.]+)mm"), F.lit(1)).alias("label"), F.regexp_extract_all("clause", F.lit("H([0-9]+)=([0-9.]+)mm"), F.lit(2)).alias("height"))
    return clause.select("doc_id", "line_no", "l_partkey", "l_suppkey", F.inline(pairs)).withColumn("height", F.col("height").cast("double"))


def load_point_pairs(forces: DataFrame, heights: DataFrame) -> DataFrame:
    """Force and height of one label of a page; the height counts only if it is the only one."""
    unique = heights.groupBy("doc_id", "label").agg(F.countDistinct("height").alias("n"), F.min("height").alias("height"))
    out = forces.withColumn("label", F.substring("label", 2, 9)).groupBy("doc_id", "label").agg(F.countDistinct("force").alias("n_forces"), F.min("force").alias("force"))
    return out.join(unique, ["doc_id", "label"], "left").select("doc_id", "label", "n_forces", "force", F.when(F.col("n") == 1, F.col("height")).alias("height"))


ROUGHNESS = r"Ra ([0-9.]+)"


def mentions(notes: DataFrame) -> DataFrame:
    """doc_id, clause, value, left, right: a row for each roughness mention, with the clause's text before it and from it on."""
    clause = notes.select("doc_id", F.explode(F.split("text", CLAUSE)).alias("clause")).where(F.col("clause").rlike(ROUGHNESS))
    pieces = clause.withColumn("p", F.split(F.regexp_replace("clause", f"({ROUGHNESS})", "\u0001$1"), "\u0001"))
    each = pieces.withColumn("i", F.explode(F.sequence(F.lit(2), F.size("p"))))
    at = F.col("i")
    return each.select("doc_id", "clause", F.regexp_extract(F.element_at("p", at), ROUGHNESS, 1).cast("double").alias("value"), F.array_join(F.slice("p", 1, at - 1), "").alias("left"), F.array_join(F.slice("p", at, F.size("p")), "").alias("right"))


def roughness_mentions(notes: DataFrame) -> DataFrame:
    """Distinct (value, place) of all mentions of a page: the place is the nearest word of the clause left of the mention, else right."""
    place = F.coalesce(F.nullif(F.regexp_extract("left", "(?s).*(surface|face|bore)", 1), F.lit("")), F.nullif(F.regexp_extract("right", "(surface|face|bore)", 1), F.lit("")), F.lit("unknown"))
    return mentions(notes).select("doc_id", "value", place.alias("place")).distinct()


def evidence_quality(notes: DataFrame) -> DataFrame:
    """Best status of a value's mentions: direct, unverified (speculation) or excluded (negation)."""
    rank = F.when(F.col("clause").rlike(r"\b(no|not|without)\b"), 2).when(F.col("clause").rlike(r"\b(maybe|about|possibly)\b") | (F.length("clause") > 200), 1).otherwise(0)
    best = mentions(notes).groupBy("doc_id", "value").agg(F.min(rank).alias("r"))
    return best.select("doc_id", "value", F.element_at(F.array(F.lit("direct"), F.lit("unverified"), F.lit("excluded")), F.col("r") + 1).alias("status"))


def load_evidence_class(notes: DataFrame) -> DataFrame:
    """accept, pending or exclude a line's load candidate by its own text, with a reason and a digest as id."""
    has = F.col("text").rlike
    reason = F.when(~has("F[0-9]+="), "no_force").when(has("kN"), "large_unit").when(~has(r"\+/-[0-9]+%"), "no_tolerance").otherwise("complete")
    action = F.when(reason == "no_force", "exclude").when(reason == "complete", "accept").otherwise("pending")
    return notes.select("doc_id", "line_no", "l_partkey", "l_suppkey", action.alias("action"), reason.alias("reason"), F.substring(F.sha2("text", 256), 1, 16).alias("diagnostic_id"))


def catalog_mentions(texts: DataFrame, catalog: DataFrame, id_col: str, text_col: str, word: str) -> DataFrame:
    """First occurrence of each catalog word in a text that no longer word covers and before which, in 12 characters, no negation
    stands; in order of appearance. All occurrences are looked at, whatever the case of letters; those of one word don't overlap.
    Texts are held against blocks of the catalog."""
    low = texts.select(id_col, F.lower(text_col).alias("text")).join(blocks(catalog.select(F.lower(word).alias(word)).where(f"{word} <> ''"), word))
    hits = low.withColumn(word, F.explode(F.filter("block", lambda w: F.contains(F.col("text"), w)))).drop("block")
    # A piece ends where an occurrence begins; of each only its length and the 12 characters before its end travel.
    hits = hits.withColumn("pieces", F.expr(f"split(text, concat('\\\\Q', {word}, '\\\\E'), -1)")).drop("text")
    tails = F.transform("pieces", lambda p: F.right(p, F.lit(12)))
    before = lambda i: F.right(F.array_join(F.slice("tails", F.greatest(i - 11, F.lit(1)), F.least(i + 1, F.lit(13))), "\u0001"), F.lit(160))
    rows = F.transform("pieces", lambda p, i: F.struct(i.alias("i"), F.length(p).alias("size"), before(i).alias("before")))
    each = hits.withColumn("tails", tails).select(id_col, word, (F.size("pieces") - 1).alias("n"), F.inline(rows))
    at = 1 + F.sum("size").over(Window.partitionBy(id_col, word).orderBy("i")) + F.col("i") * F.length(word)
    negated = F.right(F.replace("before", F.lit("\u0001"), F.col(word)), F.lit(12)).rlike(r"\b(no|not|without)\b")
    found = each.withColumn("negated", negated).withColumn("at", at).where("i < n").withColumn("end", F.col("at") + F.length(word)).select(id_col, word, "at", "end", "negated")
    earlier = F.max("end").over(Window.partitionBy(id_col).orderBy("at").rangeBetween(Window.unboundedPreceding, -1))
    here = F.max("end").over(Window.partitionBy(id_col, "at"))
    found = found.withColumn("covered", F.coalesce(earlier >= F.col("end"), F.lit(False)) | (here > F.col("end")))
    first = found.where("not covered and not negated").groupBy(id_col, word).agg(F.min("at").cast("long").alias("at"))
    return first.select(id_col, word, "at", F.row_number().over(Window.partitionBy(id_col).orderBy("at", word)).cast("long").alias("n"))


# Wordings that permit a replacement, and that forbid one.
PERMITS = (
    "允许.{0,12}(?:换用|替代|代用|更换|选用|使用)", "(?:可|可以)(?:换用|改用|替换为)", "допускается.{0,50}(?:замена|заменить)", r"(?:may|can)\s+be\s+(?:replaced|substituted)",
    r"(?:permitted|allowed)\s+(?:replacement|substitut)\w*", r"(?:alternative|substitute)\s+material",
)
FORBIDS = ("不允许|未允许|未经允许|禁止|不得|不准|不能|不可", r"\b(?:not|never|no)\b", r"\b(?:не|нельзя|запрещено|запрещается)\b")
#: Words that join the grades of a list.
JOINS = "^(?:或者|或|和|及|or\\b|and\\b)\\s*"


def material_key(text: Column) -> Column:
    """Letters and digits of any script, in upper case."""
    return F.regexp_replace(F.upper(text), r"[^\p{L}\p{N}]", "")


def allowed_substitutes(notes: DataFrame, catalog: DataFrame, keys: list[str], word: str) -> DataFrame:
    """keys, clause, piece, grade, term: what a text permits in place of its material, one row a grade, with the catalog's term if the catalog
    has that grade. The text behind a permitting wording is a grade; the list goes on over the pieces between commas that are a catalog
    grade and nothing else, and ends at the first that is not, at a forbidding piece and with the clause.

    A piece that ends a list starts a segment; a segment whose first piece permits carries its permission over the rest."""
    c = F.col
    permits, forbids = "(?i)(?:" + "|".join(PERMITS) + ")", "(?i)(?:" + "|".join(FORBIDS) + ")"
    clause = notes.select(*keys, F.posexplode(F.split("text", r"[;；。\n]+|(?<!\d)[.!?]|[.!?](?!\d)")).alias("clause", "c")).where(c("c").rlike(permits))
    piece = clause.select(*keys, "clause", F.posexplode(F.split("c", r"(?<!\d)[,，]|[,，](?!\d)")).alias("piece", "p"))
    opens, closed = c("p").rlike(permits), c("p").rlike(forbids)
    behind = F.trim(F.regexp_replace(F.regexp_extract("p", f"(?s){permits}(.*)", 1), r"^\s*(?:by|with|:|：)\s*", ""))
    piece = piece.withColumn("kind", F.when(opens & closed, "forbids").when(opens, "permits").otherwise("other"))
    piece = piece.withColumn("grade", F.when(c("kind") == "permits", behind).otherwise(F.regexp_replace(F.trim("p"), f"(?i){JOINS}", ""))).withColumn("key", material_key(c("grade")))
    terms = catalog.select(material_key(F.col(word)).alias("key"), F.col(word).alias("term")).where("key <> ''").groupBy("key").agg(F.min("term").alias("term"))
    piece = piece.join(terms, "key", "left")
    order = Window.partitionBy(*keys, "clause").orderBy("piece")
    breaks = (c("kind") != "other") | c("term").isNull()
    piece = piece.withColumn("segment", F.sum(breaks.cast("long")).over(order))
    head = F.first("kind").over(Window.partitionBy(*keys, "clause", "segment").orderBy("piece"))
    return piece.withColumn("head", head).where((c("head") == "permits") & (c("grade") != "")).select(*keys, "clause", "piece", "grade", "term")


def support_origin(text: Column) -> Column:
    """inferred, total, per-end or unknown by wording, in this order."""
    return F.when(text.rlike("infer|assum"), "inferred").when(text.rlike("total"), "total").when(text.rlike("each|per end|both ends"), "per_end").otherwise("unknown")


def foreign_text(text: Column, keep: str = r"[A-Z]{1,4}[0-9/.-]*|[0-9.]+\s*(mm|kN|N|C|h)\b|\w+=\S+") -> Column:
    """Whether letters remain after standards, codes, values with units and equations are masked."""
    return F.regexp_replace(text, keep, " ").rlike("[a-z]{3,}")
