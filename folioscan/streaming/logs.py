"""Logs and requests: the batch forms, and the same rules with keyed state on streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from folioscan.limits import LIMITS


def tail(lines: DataFrame, most: int = LIMITS.tail_lines) -> DataFrame:
    """The last lines of each process."""
    w = W.partitionBy("pid").orderBy(F.desc("seq"))
    return lines.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def budgeted(lines: DataFrame, most: int = LIMITS.budget_bytes) -> DataFrame:
    """pid, seq, forwarded, cut: lines go through until the bytes before a line (each and its end) reach the budget; the first stopped line is the cut."""
    w = W.partitionBy("pid").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("line") + 1).over(w), F.lit(0).cast("long"))
    rows = lines.select("pid", "seq", (before < most).alias("forwarded"))
    cut = ~F.col("forwarded") & F.coalesce(F.lag("forwarded").over(W.partitionBy("pid").orderBy("seq")), F.lit(True))
    return rows.withColumn("cut", cut)


def crash_streaks(lines: DataFrame, most: int = 3) -> DataFrame:
    """pid, seq, streak, restart of crashes: consecutive ones without progress between; a restart while the streak is at most ``most``."""
    w = W.partitionBy("pid").orderBy("seq")
    rows = lines.withColumn("_g", F.sum((F.col("kind") == "purchase").cast("int")).over(w)).where("kind = 'error'")
    rows = rows.withColumn("streak", F.row_number().over(W.partitionBy("pid", "_g").orderBy("seq")))
    return rows.select("pid", "seq", "streak", (F.col("streak") <= most).alias("restart"))


def latest_requests(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers to the latest request of each session; those to older ones are dropped."""
    last = requests.groupBy("session").agg(F.max("request").alias("request"))
    return answers.join(last, ["session", "request"], "left_semi")


def progress(found: DataFrame) -> DataFrame:
    """doc_id, page, hits_so_far, pages_done of (doc_id, page, hits)."""
    w = W.partitionBy("doc_id").orderBy("page")
    return found.select("doc_id", "page", F.sum("hits").over(w).alias("hits_so_far"), (F.col("page") + 1).cast("long").alias("pages_done"))


def over_budget(lines: DataFrame, most: float) -> DataFrame:
    """kind, samples, over, worst."""
    return lines.groupBy("kind").agg(F.count("*").alias("samples"), F.count_if(F.col("ms") > most).alias("over"), F.max("ms").alias("worst"))


def _ordered(frames: Iterator[pd.DataFrame], *columns: str) -> list[np.ndarray]:
    """Columns of numbers of one key's rows, in the order of the first; a row is a few numbers here, never its text."""
    parts = [[f[c].to_numpy() for c in columns] for f in frames]
    whole = [np.concatenate(p) for p in zip(*parts, strict=True)]
    order = np.argsort(whole[0], kind="stable")
    return [w[order] for w in whole]


def stream_streaks(lines: DataFrame, most: int = 3) -> DataFrame:
    """crash_streaks() on a stream whose lines come in order, as from a pipe; the count of each process is its state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seq, crash, good = _ordered(frames, "seq", "crash", "good")
        crashes = np.cumsum(crash) + (state.get[0] if state.exists else 0)
        before = np.maximum.accumulate(np.where(good, crashes, 0))  # crashes up to the last progress
        streak = crashes - before
        state.update((int(streak[-1]),))
        yield pd.DataFrame({"pid": key[0], "seq": seq[crash], "streak": streak[crash], "restart": streak[crash] <= most})

    rows = lines.select("pid", "seq", (F.col("kind") == "error").alias("crash"), (F.col("kind") == "purchase").alias("good"))
    return rows.groupBy("pid").applyInPandasWithState(step, "pid long, seq long, streak int, restart boolean", "count int", "append", "NoTimeout")


def stream_budget(lines: DataFrame, most: int = LIMITS.budget_bytes) -> DataFrame:
    """budgeted() on a stream whose lines come in order, as from a pipe; the bytes of each process so far are its state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seq, size = _ordered(frames, "seq", "size")
        used, was = state.get if state.exists else (0, True)
        after = used + np.cumsum(size.astype(np.int64) + 1)
        forwarded = np.concatenate([[used], after[:-1]]) < most
        cut = np.concatenate([[was], forwarded[:-1]]) & ~forwarded
        state.update((int(after[-1]), bool(forwarded[-1])))
        yield pd.DataFrame({"pid": key[0], "seq": seq, "forwarded": forwarded, "cut": cut})

    sized = lines.select("pid", "seq", F.octet_length("line").alias("size"))
    return sized.groupBy("pid").applyInPandasWithState(step, "pid long, seq long, forwarded boolean, cut boolean", "used long, open boolean", "append", "NoTimeout")


def stream_capped(found: DataFrame, most: int = LIMITS.hits) -> DataFrame:
    """Hits of each document (doc_id, page, first) that were among its first ``most``, in page order, when they came; first_hits() takes the first of these.

    The state is the places of the first ``most`` hits so far, so the rows do not
    depend on how a stream is cut into batches once all have come.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = np.array(state.get[0] if state.exists else [], np.int64)
        for frame in frames:
            new = frame["page"].to_numpy().astype(np.int64) << 32 | frame["first"].to_numpy()
            least = np.sort(np.concatenate([held, new]))[:most]
            kept = new <= least[-1]
            held = least
            yield pd.DataFrame({"doc_id": key[0], "page": (new[kept] >> 32).astype(np.int32), "first": (new[kept] & 0xFFFFFFFF).astype(np.int32)})
        state.update((held.tolist(),))

    return found.select("doc_id", "page", "first").groupBy("doc_id").applyInPandasWithState(step, "doc_id long, page int, first int", "held array<long>", "append", "NoTimeout")


def first_hits(rows: DataFrame, most: int = LIMITS.hits) -> DataFrame:
    """doc_id, page, first: the first hits of each document among what stream_capped() gave."""
    w = W.partitionBy("doc_id").orderBy("page", "first")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def stream_tail(lines: DataFrame, most: int = LIMITS.tail_lines) -> DataFrame:
    """pid, version, seq, line: the last lines of a process each time lines arrive; version counts its lines so far.

    The state holds at most ``most`` lines of a process, and lines are taken up piece by
    piece.  The rows of a process with its largest version are its tail.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count, seqs, texts = state.get if state.exists else (0, [], [])
        held = list(zip(seqs, texts, strict=True))
        for new in frames:
            count += len(new)
            new = new.nlargest(most, "seq")
            held = sorted([*held, *zip(new["seq"].tolist(), new["line"].tolist(), strict=True)])[-most:]
        state.update((count, [s for s, _ in held], [t for _, t in held]))
        yield pd.DataFrame({"pid": key[0], "version": count, "seq": [s for s, _ in held], "line": [t for _, t in held]})

    return lines.select("pid", "seq", "line").groupBy("pid").applyInPandasWithState(step, "pid long, version long, seq long, line string", "count long, seqs array<long>, texts array<string>", "append", "NoTimeout")


def newest_tail(versions: DataFrame) -> DataFrame:
    last = versions.groupBy("pid").agg(F.max("version").alias("version"))
    return versions.join(last, ["pid", "version"]).select("pid", "seq", "line")


def stream_latest(messages: DataFrame) -> DataFrame:
    """session, request, event_id, asks: requests that are the latest of their session so far, and answers that may still fit.

    messages: session, request, event_id, asks (whether it is a request).  The latest
    request of a session is its state; answers to older ones are dropped.  Which request
    is the latest is known when all have come: latest_answers() keeps the answers to it,
    in whatever order and batches requests and answers came.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        latest = state.get[0] if state.exists else None
        for rows in frames:
            asked = rows.loc[rows["asks"], "request"]
            newest = int(asked.max()) if len(asked) else None
            if newest is not None and (latest is None or newest > latest):
                latest = newest
                yield pd.DataFrame({"session": [key[0]], "request": [latest], "event_id": pd.array([None], "Int64"), "asks": [True]})
            fits = ~rows["asks"] if latest is None else ~rows["asks"] & (rows["request"] >= latest)
            yield rows.loc[fits, ["session", "request", "event_id", "asks"]]
        if latest is not None:
            state.update((latest,))

    return messages.select("session", "request", "event_id", "asks").groupBy("session").applyInPandasWithState(step, "session long, request long, event_id long, asks boolean", "request long", "append", "NoTimeout")


def latest_answers(rows: DataFrame) -> DataFrame:
    """session, request, event_id: of what stream_latest() gave, the answers to the latest request of each session."""
    return latest_requests(rows.where("asks"), rows.where("not asks")).select("session", "request", "event_id")


class SearchProgress(StreamingQueryListener):
    """What a stream marked with observed() has met, batch by batch: counts holds (batch, documents' hits, pages with hits)."""

    NAME = "search_progress"

    def __init__(self) -> None:
        self.counts: list[tuple[int, int, int]] = []
        self.done: set[str] = set()

    @classmethod
    def observed(cls, found: DataFrame) -> DataFrame:
        """The hits (doc_id, page, ..) of a search, counted as they pass."""
        return found.observe(cls.NAME, F.count("*").alias("hits"), F.count_if(F.col("first_of_page")).alias("pages")).drop("first_of_page")

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.NAME)
        if row is not None:
            self.counts.append((event.progress.batchId, row["hits"], row["pages"]))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.done.add(str(event.id))
