"""The match and notify flows (query lifecycle 3.2) composed from the operators:
unnotified top-k by stored score (P06 T02) -> company join (J01) -> postings (S10) ->
scoring (J04 G01-G04) -> threshold and order (P04 T01) -> report / messages / digest
(K03 F19-F21 A06) -> mark notified (K04)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import reports, scoring
from ..sources.ats import read_stored_postings
from ..store.changelog import ChangeLog
from ..store.jobs import unseen_top


def match(jobs: DataFrame, companies: DataFrame | None, profiles, as_of, *, limit: int | None = None,
          min_score: float | None = 0.3, since=None) -> DataFrame:
    """Score the unnotified stored jobs (with ``limit``, that many of the best); keep >= threshold, best first."""
    top = unseen_top(jobs, None, limit, since)
    postings = read_stored_postings(top, companies)
    return scoring.score_batch(postings, profiles, as_of, min_score=min_score, order_col="id")


def notify(store: ChangeLog, companies: DataFrame | None, profiles, as_of, *, limit: int | None = None,
           mode: str = "push", target: str = "jobs"):
    """Messages and digest for the best unnotified jobs above each profile's own
    threshold, then mark them notified. Returns (messages, digest, notifications).

    The store is read as of the batch before the flow's own, so the returned
    messages and digest (evaluated lazily, after the jobs were marked) still describe
    what was notified."""
    batch = store.last_batch() + 1
    jobs = store.jobs(before=batch)
    scored = match(jobs, companies, profiles, as_of, limit=limit, min_score=None)
    msgs = reports.messages(scored, target)
    digest = reports.digest(scored)
    notes = store.notify(scored.select("id"), mode, target, as_of, batch)
    return msgs, digest, notes
