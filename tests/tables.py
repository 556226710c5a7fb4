"""Tables of the test data's shapes: empty, and with nulls, blanks, repeated rows and long texts everywhere."""

from __future__ import annotations

import datetime

SCHEMAS = {
    "pt_crawl": "crawl_id long, page_key string, url string, host string, page string, content_type string, response_code int, page_length int, fetched_at timestamp, loaded_at timestamp",
    "pt_index": "posting_id long, term string, urls string, shard int, indexed_at timestamp, loaded_at timestamp",
    "pt_tf": "doc string, term string, value double, chunk int",
    "pt_pageranks": "page_key string, rank double, prev double, computed_at timestamp",
    "pt_idf": "term string, idf double",
    "hosts": "host string, rules array<struct<rule_type:string,prefix:string>>, crawl_delay double, last_access long, url_count int",
    "crawl_files": "file_id long, file_path string, worker string, n_bytes long, written_at timestamp, body binary",
    "search_queries": "query_id long, term string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, url string, site string, crawled_at timestamp",
    "mix_targets": "source string, target_share double, max_repeats int",
}
_VALUES = {
    "string": [None, "", " ", "a", "term", "wiki", "http://a.test:80/x", "<p>One line of text here. Another line of it.</p>\n" * 300, "cafÃ© Ã©tÃ©"],
    "long": [None, 0, 1, 1, 2],
    "int": [None, 0, 1],
    "double": [None, 0.0, 0.5, 0.5],
    "timestamp": [None, datetime.datetime(2024, 1, 1)],
    "binary": [None, bytearray(b""), bytearray(b"k crawlId 1 7 \n"), bytearray(b"k crawlId 1 7 page 3 a")],
}


def columns(schema: str) -> list[tuple[str, str]]:
    out = []
    for part in schema.replace("array<struct<rule_type:string,prefix:string>>", "rules").split(", "):
        name, kind = part.split(" ")
        out.append((name, kind))
    return out


def odd_rows(schema: str, n: int = 60) -> list[tuple]:
    """Rows that walk through all values of each column at different paces, each twice."""
    rows = []
    for i in range(n):
        row = []
        for j, (_, kind) in enumerate(columns(schema)):
            values = _VALUES.get(kind, [None, [], [(None, None)], [("allow", "")]])
            row.append(values[(i // (j % 3 + 1) + j) % len(values)])
        rows += [tuple(row)] * 2
    return rows


def write(spark, folder: str, odd: bool) -> str:
    for name, schema in SCHEMAS.items():
        rows = odd_rows(schema) if odd else []
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder
