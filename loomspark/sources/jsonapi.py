"""A paged JSON:API source, and its documents as rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Pages asked for unless the caller says how many there are; times a page is asked for before the read fails.
MOST_PAGES, TRIES = 100, 3
ITEM = "struct<id: string, type: string, attributes: map<string, string>, relationships: map<string, string>>"


class Pages(DataSourceReader):
    """One partition for each page number. A page that does not exist (404) or has no data gives no row; any other error, and
    data on the page after the last one asked for, fail the read."""

    def __init__(self, options: dict[str, str]):
        self.url, self.pages = options["url"], int(options.get("pages", MOST_PAGES))

    def partitions(self):
        return [InputPartition(i) for i in range(1, self.pages + 2)]

    def read(self, partition):
        from urllib.error import HTTPError
        from urllib.request import urlopen

        for left in reversed(range(TRIES)):
            try:
                with urlopen(self.url.replace("{page}", str(partition.value)), timeout=60) as r:
                    body = r.read().decode()
                break
            except HTTPError as e:
                if e.code == 404:
                    return
                if not left:
                    raise
            except FileNotFoundError:
                return
            except OSError as e:
                if isinstance(getattr(e, "reason", None), FileNotFoundError):
                    return
                if not left:
                    raise
        if json.loads(body).get("data"):
            if partition.value > self.pages:
                raise ValueError(f"there are more than {self.pages} pages; say how many")
            yield partition.value, body


class JsonApi(DataSource):
    """``spark.read.format("loom_jsonapi").option("url", "https://.../{page}")``: page, body."""

    @classmethod
    def name(cls) -> str:
        return "loom_jsonapi"

    def schema(self) -> str:
        return "page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return Pages(self.options)


def read_pages(spark: SparkSession, url: str, pages: int = MOST_PAGES) -> DataFrame:
    spark.dataSource.register(JsonApi)
    return spark.read.format("loom_jsonapi").option("url", url).option("pages", str(pages)).load()


def comments(pages: DataFrame) -> DataFrame:
    """id, text, respondent: comments with their content and user from the page's included items; withdrawn and empty ones go.

    Text parts of one comment are joined by a blank line, in the order in which it names them.
    """
    parsed = pages.select("page", F.from_json("body", f"data array<{ITEM}>, included array<{ITEM}>").alias("b"))
    data = parsed.select("page", F.explode("b.data").alias("c"))
    included = parsed.select("page", F.explode("b.included").alias("i")).select("page", F.col("i.id").alias("ref"), F.col("i.type").alias("kind"), F.col("i.attributes").alias("a"))
    refs = F.from_json(F.get_json_object(F.col("c.relationships")["contents"], "$.data"), "array<struct<id: string, type: string>>")
    parts = data.select("page", F.col("c.id").alias("id"), F.col("c.attributes").alias("attributes"), F.get_json_object(F.col("c.relationships")["user"], "$.data.id").alias("user"), F.posexplode_outer(refs).alias("pos", "ref_item"))
    text = parts.join(included.where("kind = 'content'"), (parts["page"] == included["page"]) & (F.col("ref_item.id") == F.col("ref")), "left").select(parts["page"], "id", "attributes", "user", "pos", F.col("a")["textContent"].alias("part"))
    packed = F.array_sort(F.collect_list(F.when(F.length(F.trim("part")) > 0, F.struct("pos", "part"))))
    rows = text.groupBy("page", "id", "user", F.coalesce(F.col("attributes")["isDeleted"], F.lit("false")).alias("deleted")).agg(F.array_join(F.transform(packed, lambda x: x["part"]), "\n\n").alias("text"))
    users = included.where("kind = 'user'").select(F.col("page").alias("__p"), F.col("ref").alias("__u"), F.col("a")["name"].alias("respondent"))
    out = rows.where("deleted <> 'true' AND text <> ''").join(users, (F.col("page") == F.col("__p")) & (F.col("user") == F.col("__u")), "left")
    return out.select(F.expr("try_cast(id AS bigint)").alias("id"), "text", "respondent").where("id is not null")


#: Letters that were read in the wrong encoding, and what they were.
MOJIBAKE = {"Ã¦": "æ", "Ã¸": "ø", "Ã¥": "å", "Ã†": "Æ", "Ã˜": "Ø", "Ã…": "Å", "Ã©": "é", "â€™": "'", "â€œ": "\"", "â€“": "-"}


def fix_encoding(column: str):
    """Literal repairs in order, without replacement characters, trimmed."""
    out = F.col(column)
    for wrong, right in MOJIBAKE.items():
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return F.trim(F.replace(out, F.lit("�"), F.lit("")))
