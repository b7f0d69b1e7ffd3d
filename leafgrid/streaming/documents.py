"""Streams of pages put together to whole documents, with state that outlives a restart."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAGES = "doc_id string, page_num int, num_pages int, payload string, complete boolean"


def whole_documents(pages: DataFrame, wait: str = "10 minutes") -> DataFrame:
    """The pages of each document once all are there: doc_id, page_num, num_pages, payload, complete.

    pages: a stream of doc_id, page_num (from 0), num_pages, payload and ts.  State holds a document's
    pages until its last comes; when event time has passed its latest page by wait, what is there is
    given out with complete = false.  A page that comes twice counts once, the first time; of page counts
    that differ the greatest holds; pages outside the count, rows with a null id or page and rows later than the
    watermark are left out.  A document of which all was given out begins anew if it comes again.

    State is dealt by document and holds open documents alone; results are appended, and a restart
    from the query's checkpoint goes on with the state of the last finished batch.
    """
    seconds = F.unix_timestamp("ts").cast("double")
    rows = pages.filter("doc_id IS NOT NULL AND page_num >= 0").withWatermark("ts", wait)
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page_num").cast("int").alias("page_num"), F.coalesce(F.col("num_pages").cast("int"), F.lit(0)).alias("num_pages"), F.col("payload").cast("string").alias("payload"), "ts", seconds.alias("at"))
    delay = pd.Timedelta(wait).total_seconds()

    def gather(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        asked = state.get[1] if state.exists else 0
        latest = state.get[2] if state.exists else 0.0
        if not state.hasTimedOut:
            for part in batches:
                for page, n, payload, at in zip(part["page_num"], part["num_pages"], part["payload"], part["at"], strict=True):
                    held.setdefault(str(page), payload)
                    asked, latest = max(asked, int(n)), max(latest, float(at))
        whole = asked > 0 and all(str(i) in held for i in range(asked))
        if whole or state.hasTimedOut:
            state.remove()
            found = sorted((int(p), x) for p, x in held.items() if int(p) < asked or not asked)
            if found:
                yield pd.DataFrame({"doc_id": key[0], "page_num": [p for p, _ in found], "num_pages": asked, "payload": [x for _, x in found], "complete": whole})
            return
        state.update((json.dumps(held), asked, latest))
        state.setTimeoutTimestamp(max(int((latest + delay) * 1000), state.getCurrentWatermarkMs() + 1))

    return rows.groupBy("doc_id").applyInPandasWithState(gather, PAGES, "held string, asked int, latest double", "append", GroupStateTimeout.EventTimeTimeout)
