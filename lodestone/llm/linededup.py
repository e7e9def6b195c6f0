"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut_lineage, fresh, table

#: Code points of the window within which variants are made; what surrounds it is compared by hash.
WINDOW = 64


def numbered_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, twin, line_no, line) for each line that isn't blank; twin is a hash of the whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("twin"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def first_places(lines: DataFrame) -> DataFrame:
    """The earliest place of each distinct line, with the keys of its halves.

    An edit leaves one half of the shorter line as it is: two lines of n, or
    of n and n + 1 code points, that are one edit apart agree in the first
    n div 2 code points or in the last n - n div 2. Each line has the keys of
    its length and, as the longer one, of the length below.
    """
    n = F.length("line")
    keys = []
    for frame in (n, n - 1):
        half = F.expr("length(line) div 2") if frame is n else F.expr("(length(line) - 1) div 2")
        keys.append(F.xxhash64(F.lit("head"), frame, F.substring("line", F.lit(1), half)))
        keys.append(F.xxhash64(F.lit("tail"), frame, F.expr(f"right(line, {'length(line)' if frame is n else 'length(line) - 1'} - {'length(line) div 2' if frame is n else '(length(line) - 1) div 2'})")))
    place = F.struct("doc", "twin", "line_no")
    hashed = lines.select(F.xxhash64("line").alias("h"), F.hash("line").alias("g"), place.alias("place"), F.array(*keys).alias("halves"))
    return hashed.groupBy("h", "g", "halves").agg(F.min("place").alias("place"))


def variants(lines: DataFrame) -> DataFrame:
    """(context, i, place) for the lines (place, line) whose windows some other line's may equal but for one edit.

    For each window of a line, context is a hash of what surrounds it and of
    the length that a variant has. Windows whose context no other line has
    are left out, but for lines of one window, whose context is their length
    and rules out little; of the others come all variants that lack one code point
    (i: which one) and, as the variant of a longer line, the window itself
    (i: 0).
    """
    n = F.length("line")

    def windows(width: int, frame: Column, last: str) -> Column:
        from_ = lambda j: j * WINDOW
        return F.transform(
            F.expr(f"sequence(0, ({last}) div {WINDOW})"),
            lambda j: F.struct(
                F.xxhash64(j, frame, F.xxhash64(F.substring(F.col("line"), F.lit(1), from_(j))), F.xxhash64(F.substring(F.col("line"), from_(j) + width + 1, n))).alias("context"),
                j.alias("j"),
                F.substring(F.col("line"), from_(j) + 1, F.lit(width)).alias("part"),
                F.lit(width == WINDOW).alias("shorten"),
            ),
        )

    around = lines.select("place", (n < WINDOW).alias("whole"), F.explode(F.concat(windows(WINDOW, n - 1, "length(line) - 1"), windows(WINDOW - 1, n, "length(line)"))).alias("w")).select("place", "whole", "w.*")
    around = cut_lineage(around)
    parts = around.where("not whole")
    shared = parts.groupBy("context").agg(F.count("*").alias("n")).where("n > 1").select("context")
    met = around.where("whole").unionByName(parts.join(shared, "context", "left_semi"))
    less = F.transform(
        F.sequence(F.lit(1), F.length("part")),
        lambda i: F.struct(F.xxhash64(F.col("context"), F.concat(F.substring(F.col("part"), F.lit(1), i - 1), F.substring(F.col("part"), i + 1, F.lit(WINDOW)))).alias("context"), (F.col("j") * WINDOW + i).cast("int").alias("i")),
    )
    same = F.array(F.struct(F.xxhash64(F.col("context"), F.col("part")).alias("context"), F.lit(0).alias("i")))
    return met.select("place", F.explode(F.when(F.col("shorten") & (F.length("part") > 0), less).when(~F.col("shorten"), same).otherwise(F.array().cast("array<struct<context:bigint,i:int>>"))).alias("v")).select("place", "v.*")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, twin, line_no) of every line that has an equal or nearly equal line before it.

    Places come by document id, text hash and line number. A line is dropped
    if an earlier line, of any length, is equal to it or one edit (insertion,
    deletion, substitution) away, even if that line is dropped itself. Each
    hashed variant keeps only the earliest place, so lines of which thousands
    are alike form no pairs.
    """
    lines = numbered_lines(docs, id_col, text_col)
    firsts = cut_lineage(first_places(lines))
    halves = firsts.select("place", F.explode("halves").alias("half"))
    crowded = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    chosen = halves.join(crowded, "half", "left_semi").select("place").distinct().select("place.*")
    here = lines.select(F.struct("doc", "twin", "line_no").alias("place"), "line")
    named = chosen.select(F.struct("doc", "twin", "line_no").alias("place"))
    near = cut_lineage(here.join(named, "place", "left_semi").distinct())
    made = variants(near)
    by_all, by_one = Window.partitionBy("context"), Window.partitionBy("context", "i")
    partner = F.when(F.col("i") > 0, F.least(F.min("place").over(by_one), F.min(F.when(F.col("i") == 0, F.col("place"))).over(by_all))).otherwise(F.min(F.when(F.col("i") > 0, F.col("place"))).over(by_all))
    earliest = made.withColumn("partner", partner).where("partner < place").groupBy("place").agg(F.min("partner").alias("partner"))
    texts = near.select(F.col("place").alias("partner"), F.col("line").alias("partner_line"))
    verified = earliest.join(near, "place").join(texts, "partner").where(F.levenshtein(F.col("line"), F.col("partner_line"), 1) >= 0)
    near_firsts = cut_lineage(verified.select("place").distinct())
    hashed = lines.select("doc", "twin", "line_no", F.xxhash64("line").alias("h"), F.hash("line").alias("g"))
    kept = firsts.join(near_firsts, "place", "left_anti").select("place.*")
    kept = kept.select(F.col("doc").alias("kept_doc"), F.col("twin").alias("kept_twin"), F.col("line_no").alias("kept_no"))
    same = F.col("doc").eqNullSafe(F.col("kept_doc")) & (F.col("twin") == F.col("kept_twin")) & (F.col("line_no") == F.col("kept_no"))
    return hashed.join(kept, same, "left_anti").select("doc", "twin", "line_no").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text's dropped lines left out, and n_lines and n_dropped.

    Blank lines stay, and so does the order of lines. Null texts stay null
    and count no line. Repeated rows (same id and text) are treated alike:
    each keeps what the first of them keeps. Columns of docs named n_lines or
    n_dropped are replaced; an empty table gives an empty result.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own, gone_doc, gone_twin, gone, lines = fresh(docs.columns, "twin", "gone_doc", "gone_twin", "gone", "lines")
    dropped = dropped_lines(docs, id_col, text_col).groupBy("doc", "twin").agg(F.sort_array(F.collect_list("line_no")).alias("numbers"))
    dropped = dropped.select(F.col("doc").alias(gone_doc), F.col("twin").alias(gone_twin), F.col("numbers").alias(gone))
    text = F.col(text_col).cast("string")
    rows = docs.select(*columns, F.xxhash64(F.coalesce(text, F.lit(""))).alias(own))
    joined = rows.join(dropped, F.col(id_col).eqNullSafe(F.col(gone_doc)) & (F.col(own) == F.col(gone_twin)), "left").withColumn(lines, F.split(text, "\n"))
    whole = F.col(gone).isNull() | F.col(text_col).isNull()
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.element_at(lines, i + 1)), "\n")
    out = joined.withColumn(text_col, F.when(whole, text).otherwise(kept))
    out = out.withColumn("n_lines", F.when(F.col(lines).isNull(), 0).otherwise(F.size(lines)).cast("long")).withColumn("n_dropped", F.coalesce(F.size(gone), F.lit(0)).cast("long"))
    return out.select(*columns, "n_lines", "n_dropped")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, n_lines and n_dropped of every document after line dedup."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_sql() -> str:
    """The same as DuckDB SQL: lines that share a half are compared from their first differing code point on."""
    halves = " UNION ALL ".join(
        f"SELECT place, line, {frame} AS frame, '{side}' AS side, md5({part}) AS part FROM firsts"
        for frame in ("n", "n - 1")
        for side, part in (("head", f"left(line, ({frame}) // 2)"), ("tail", f"right(line, {frame} - ({frame}) // 2)"))
    )
    return rf"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents
), lines AS (
  SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS solid, row_number() OVER (ORDER BY doc_id, line_no) AS place FROM split
), firsts AS (
  SELECT line, min(place) AS place, length(line) AS n FROM lines WHERE solid GROUP BY line
), halves AS (
  {halves}
), pairs AS (
  SELECT DISTINCT a.place AS first, b.place AS later,
    CASE WHEN length(a.line) <= length(b.line) THEN a.line ELSE b.line END AS short,
    CASE WHEN length(a.line) <= length(b.line) THEN b.line ELSE a.line END AS long
  FROM halves a JOIN halves b ON a.frame = b.frame AND a.side = b.side AND a.part = b.part AND a.place < b.place
), agreeing AS (
  SELECT *, coalesce(list_position(list_transform(range(1, length(short) + 1), lambda i: substr(short, i, 1) <> substr(long, i, 1)), true) - 1, length(short)) AS p FROM pairs
), gone AS (
  SELECT DISTINCT later AS place FROM agreeing
  WHERE CASE WHEN length(short) = length(long) THEN substr(short, p + 2) = substr(long, p + 2) ELSE substr(short, p + 1) = substr(long, p + 2) END
), kept AS (
  SELECT place FROM firsts WHERE place NOT IN (SELECT place FROM gone)
), told AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT solid OR place IN (SELECT place FROM kept)) AS left_over,
    count(*) FILTER (WHERE solid AND place NOT IN (SELECT place FROM kept)) AS n_dropped
  FROM lines GROUP BY doc_id
)
SELECT doc_id, CASE WHEN n_dropped > 0 THEN coalesce(left_over, '') ELSE text END AS text,
  CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped
FROM documents LEFT JOIN told USING (doc_id)"""
