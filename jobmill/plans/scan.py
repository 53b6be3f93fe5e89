"""Batch scan (M05): landed postings -> company filter -> lookback -> drop stored ids
-> exact dedup -> SimHash -> ordered near-duplicate fold -> (optional) store and run
log. Every step is a DataFrame transformation; only the fold's boundary summaries
reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import searchable_text
from ..operators import dedup, filters
from ..session import ensure_checkpoint_dir
from ..store.changelog import ChangeLog


def scan(postings: DataFrame, companies: DataFrame | None, as_of, lookback: str | None,
         stored: DataFrame | None = None, *, order_col: str = "seq",
         fuzzy_cols=("title", "location"), max_results: int | None = None):
    """Returns (kept postings, run totals). ``postings`` need an ``id`` column and an
    arrival order ``order_col``. ``max_results`` keeps the first n kept postings in
    arrival order (counts are computed before that limit)."""
    p = postings
    if companies is not None:
        p = filters.company_filter(p, companies)                                   # P01
    if lookback:
        p = filters.time_filter(p, as_of, lookback)                                # P02
    if stored is not None:
        p = filters.drop_known(p, stored, key="id")                                # J02
    # A05 is a per-row map: fingerprint before W01 so it rides along with the row
    # (no join back by id); W01 then keeps the first arrival per exact key.
    p = p.withColumn("_fkey", dedup.fuzzy_key(*fuzzy_cols)) \
        .withColumn("_fp", dedup.fingerprint(searchable_text()))                    # A05
    p = dedup.exact_dedup(p, order_col)                                            # W01
    # Both the fold and the semi-join back read the deduplicated postings: write them
    # once to the shared checkpoint folder instead of recomputing filters,
    # fingerprints and the dedup shuffle twice (also cuts the lineage).
    ensure_checkpoint_dir(p.sparkSession)
    p = p.checkpoint(eager=True)
    folded = dedup.near_dup_fold(p.select("id", "_fkey", order_col, "_fp"),
                                 "_fkey", order_col, "_fp", "id")                  # W02
    kept = p.join(folded.filter("admitted").select("id"), "id", "left_semi").drop("_fp", "_fkey")
    totals = kept.agg(F.count(F.lit(1)).alias("jobs_found"), F.count(F.lit(1)).alias("jobs_new"))
    if max_results is not None:
        kept = kept.orderBy(order_col).limit(max_results)                          # T03
    return kept, totals


def scan_report(kept: DataFrame, as_of) -> DataFrame:
    """K03 scan report rows: title, company, location, apply URL, freshness."""
    from ..functions.timeutil import freshness_label
    return kept.select("title", "company", "location", "apply_url",
                       freshness_label("posted_at", as_of).alias("freshness"))


def scan_and_store(store: ChangeLog, run_id: int, postings: DataFrame, companies: DataFrame | None, as_of, lookback: str | None,
                   **options) -> dict:
    """M05 with K01, K02, K05, K06: one logged run that scans, saves what it kept as one batch and
    creates the companies it meets. Returns the run's totals, which the save has counted. A run
    that fails is logged as failed, with its error, and the error goes on."""
    store.start_run(run_id, as_of)
    try:
        kept, _ = scan(postings, companies, as_of, lookback, store.ids(), **options)
        totals = store.save(kept, as_of, order_col=options.get("order_col", "seq"))
    except Exception as e:
        store.complete_run(run_id, as_of, None, "failed", f"{type(e).__name__}: {e}"[:500])
        raise
    store.complete_run(run_id, as_of, totals)
    return totals
