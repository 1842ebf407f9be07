r"""Line dedup by site-relative frequency: a line that too large a share of a host's pages contain is
boilerplate of that host and is dropped from all its pages. DataFrame functions only.

A page's lines are its visible runs of text: scripts, styles and comments go, tags and line ends
separate, and lines are trimmed. A host's boilerplate is at most (mean lines a page) / ratio lines,
since each takes up that share of its pages, so it travels as one bounded array per host.

Defined cases: null html has no lines and gives an empty text; a null url belongs to the host "";
a null page_id is kept; repeated rows are pages of their own; a repeated line counts once a page;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .url_filter import host_and_path

RATIO, LEAST_PAGES = 0.2, 5
#: A host with more than 1/hot of all pages has them dealt over so many groups; there are fewer than `hot` such
#: hosts. hot is this many times the shuffle partitions.
SPREAD = 8


def page_lines(html: Column) -> Column:
    """The visible runs of text, in order."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "\n")
    return F.filter(F.transform(F.split(bare, r"(?:<[^>]*>|[\r\n])+"), lambda x: F.trim(x)), lambda x: x != "")


def _mark(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def boilerplate(lined: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, marks) from (host, lines): digests of the lines on more than that share of the host's
    pages and at least so many. Counts combine before the shuffle, so a hot host or line moves few rows."""
    pages = lined.groupBy("host").agg(F.count("*").alias("pages"))
    marks = lined.select("host", F.explode(F.array_distinct(F.transform("lines", _mark))).alias("mark"))
    counts = marks.groupBy("host", "mark").agg(F.count("*").alias("on"))
    often = counts.where(F.col("on") >= least_pages).join(pages, "host").where(F.col("on") > ratio * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("mark").alias("marks"))


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, host, n_lines, n_dropped, text (kept lines, a line each): a row per page."""
    lined = pages.select("page_id", host_and_path(F.col("url"))[0].alias("host"), page_lines(F.col("html")).alias("lines"))
    per_host = pages.select(host_and_path(F.col("url"))[0].alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    groups = SPREAD * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = per_host.agg(F.sum("n").alias("total"))
    hot = per_host.crossJoin(F.broadcast(total)).where(F.col("n") * groups > F.col("total")).select("h")  # total is one row
    often = boilerplate(lined.select("host", "lines"), ratio, least_pages).join(F.broadcast(hot), F.col("host") == F.col("h"), "left")
    often = often.select(F.col("host").alias("b_host"), "marks", F.explode(F.sequence(F.lit(0), F.when(F.col("h").isNull(), 0).otherwise(groups - 1))).alias("b_part"))
    dealt = lined.join(F.broadcast(hot), F.col("host") == F.col("h"), "left").withColumn("part", F.when(F.col("h").isNull(), 0).otherwise(F.pmod(F.xxhash64("page_id", F.size("lines")), F.lit(groups))).cast("int"))
    beside = dealt.join(often, (F.col("host") == F.col("b_host")) & (F.col("part") == F.col("b_part")), "left")
    keep = F.when(F.col("marks").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("marks"), _mark(x))))
    kept = beside.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), keep.alias("kept"))
    return kept.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
