"""Jobs over tables of messages: parsed dumps, newest messages, history, parts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteflow.functions import text as x
from quoteflow.functions.values import strip
from quoteflow.operators.common import number_rows, running_sum
from quoteflow.sources.store import stored

# Fixed values.
CHUNK_CHARS = 4000
OVERLAP_CHARS = 400
IMAGES_PER_PART = 3
QUOTED_SHOWN = 10


def parse_raw_messages(raw: DataFrame) -> DataFrame:
    """Dumps as messages: sender, people, subject, body, attachments, and what could not be recovered.

    The date is never guessed; a header that has one gives a warning.
    """
    normal = raw.withColumn("normal", x.normalize_text(F.col("raw_text")))
    cut = normal.withColumn("parts", x.split_headers(F.col("normal")))
    headers = F.col("parts.headers")

    def header(key: str) -> Column:
        return F.try_element_at(headers, F.lit(key))

    dated = (F.coalesce(header("sent"), F.lit("")) != "") | (F.coalesce(header("date"), F.lit("")) != "")
    warnings = F.array_compact(
        F.array(F.when(F.size(headers) == 0, x.NO_HEADER_BLOCK), F.when(dated, x.DATE_NOT_PARSED))
    )
    people = x.parse_addresses(header("from"))
    return cut.select(
        *[name for name in raw.columns if name != "raw_text"],
        F.try_element_at(people, F.lit(1)).alias("sender"),
        x.parse_addresses(header("to")).alias("to"),
        x.parse_addresses(header("cc")).alias("cc"),
        F.when(header("subject") != "", header("subject")).alias("subject"),
        F.col("parts.body").alias("body"),
        x.parse_attachments(header("attachments")).alias("attachments"),
        warnings.alias("warnings"),
    )


def newest_messages(messages: DataFrame, **rules) -> DataFrame:
    """Each body's newest message without boilerplate, the rules that fired, and how many messages it quotes."""
    cut = messages.withColumn("thread", x.split_thread(F.col("body")))
    clean = cut.withColumn("clean", x.strip_boilerplate(F.col("thread.latest"), **rules))
    return clean.select(
        *messages.columns,
        F.col("thread.latest").alias("latest"),
        F.col("clean.text").alias("newest"),
        F.col("clean.applied").alias("applied"),
        F.size("thread.quoted").alias("quoted_count"),
        F.col("thread.warnings").alias("thread_warnings"),
    )


def quoted_messages(messages: DataFrame, key: str) -> DataFrame:
    """(key, ord, raw, from_address, sent_at, subject): the messages quoted in each body, newest first."""
    cut = messages.select(key, x.split_thread(F.col("body")).alias("thread"))
    return cut.select(key, F.posexplode("thread.quoted").alias("ord", "q")).select(key, "ord", "q.*")


def removed_share(newest: DataFrame) -> DataFrame:
    """One row: characters before and after, and the share taken out of the newest messages."""
    before, after = F.sum(F.length("latest")), F.sum(F.length("newest"))
    return newest.agg(
        before.alias("chars_before"), after.alias("chars_after"), F.round(1 - after / before, 6).alias("removed_share")
    )


def recent_history(quoted: DataFrame, key: str, shown: int = QUOTED_SHOWN) -> DataFrame:
    """The newest `shown` quoted messages of each message, and how many more there were.

    `quoted` carries `ord`, newest first. Only the shown ones are sorted; the others are counted.
    """
    newest = Window.partitionBy(key).orderBy("ord")
    top = quoted.withColumn("number", F.row_number().over(newest)).where(F.col("number") <= shown)
    counts = quoted.groupBy(key).agg(F.count(F.lit(1)).alias("quoted_count"))
    return top.join(counts, key).withColumn("omitted", F.greatest(F.col("quoted_count") - shown, F.lit(0)))


def _next_starts(sizes: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, n, next): where the part after one that begins with page n begins, if there is such a page.

    That is the first page whose running length goes more than `limit` past what lies before n. Running lengths are cut
    into stretches of `limit` characters, which hold at most so many pages; a page is looked for in the stretch its length
    points to, and else is the first page of the next stretch that has one.
    """
    value = F.col("upto") - F.col("chars") + limit + 1
    ends = sizes.select(key, F.floor(F.col("upto") / limit).alias("stretch"), F.col("upto").alias("value"), F.col("n").alias("page"))
    asked = sizes.select(key, F.floor(value / limit).alias("stretch"), value.alias("value"), "n", "chars")
    both = ends.unionByName(asked, allowMissingColumns=True)
    # Of a page and a question of one value the page comes first, as the values run down.
    onwards = Window.partitionBy(key, "stretch").orderBy(F.desc("value"), F.col("page").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    found = both.withColumn("here", F.last("page", ignorenulls=True).over(onwards)).where("n is not null")
    later = Window.partitionBy(key).orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    heads = both.groupBy(key, "stretch").agg(F.min("page").alias("first")).withColumn("after", F.min("first").over(later))
    after = heads.select(key, "stretch", "after")
    met = found.join(after, [key, "stretch"])
    following = F.when(F.col("chars") > limit, F.col("n") + 1).otherwise(F.coalesce("here", "after"))
    return met.select(key, "n", following.alias("next")).where("next is not null")


def chunk_parts(pages: DataFrame, key: str, limit: int = CHUNK_CHARS) -> DataFrame:
    """Pages with the part they are read in: pages are packed in order while they fit, one too long stands alone.

    `pages` carries `page_no` and `text`; pages that say nothing are left out. Where a part begins depends on where the
    one before ended. Each page first learns where the next part would begin if one began with it; following these from
    the first page, in jumps twice as long each round, finds the pages parts really begin with. No document is gathered
    in one row, and a document of n parts takes log2(n) rounds.
    """
    filled = pages.where(strip("text") != "").withColumn("chars", F.length("text").cast("long"))
    numbered = number_rows(filled.select(key, "page_no", "chars"), [key], "page_no", "n")
    sizes = stored(running_sum(numbered, [key], "n", "chars", "upto"), "sizes")
    starts = sizes.where("n = 1").select(key, "n")
    jumps = stored(_next_starts(sizes, key, limit), "jumps")
    while not jumps.isEmpty():
        reached = starts.join(jumps, [key, "n"]).select(key, F.col("next").alias("n"))
        starts = stored(starts.unionByName(reached), "starts")
        further = jumps.select(key, F.col("n").alias("next"), F.col("next").alias("further"))
        jumps = stored(jumps.join(further, [key, "next"]).select(key, "n", F.col("further").alias("next")), "jumps")
    begun = sizes.join(starts.withColumn("begins", F.lit(1).cast("long")), [key, "n"], "left").select(
        key, "page_no", "n", F.coalesce("begins", F.lit(0).cast("long")).alias("begins")
    )
    placed = running_sum(begun, [key], "n", "begins", "part").select(key, "page_no", F.col("part").cast("int").alias("part_no"))
    return filled.drop("chars").join(placed, [key, "page_no"])


def part_tails(parts: DataFrame, key: str) -> DataFrame:
    """(key, part_no, tail): the end of each part's last page, shown with the next part."""
    last = parts.groupBy(key, "part_no").agg(F.max_by(F.right("text", F.lit(OVERLAP_CHARS)), "page_no").alias("tail"))
    return last.select(key, (F.col("part_no") + 1).alias("part_no"), "tail")


def image_parts(images: DataFrame) -> DataFrame:
    """Images with the part they are read in, three to a part; `image_no` counts from one."""
    return images.withColumn("part_no", F.floor((F.col("image_no") - 1) / IMAGES_PER_PART).cast("long") + 1)
