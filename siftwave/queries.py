"""Every query by name, and its DuckDB SQL where there is one. Queries run over whole tables and whole texts."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any, NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import complement, low_bits, part, strided_sum
from .operators import coverage, folds, stats
from .operators.grids import Cell, grid_density, run_stats
from .operators.orders import explicit_directed
from .operators.schemes import Scheme, explicit_local, get_scheme, sample, user_scheme
from .plans import bounds, debruijn, explore, oracle, search
from .sources import sinks
from .sources.records import file_pieces
from .sources.text import sequences, spelled
from .streaming.sampler import STORE, sample_stream

Query = Callable[[SparkSession, str], DataFrame]

#: Tables of texts: id and text columns.
TEXTS = {"documents": ("doc_id", "text"), "benchmark": ("item_id", "text"), "pages": ("page_id", "html")}


class Grid(NamedTuple):
    """A scheme over a table of texts."""

    table: str
    scheme: str
    w: int
    k: int
    sigma: int = 256
    params: tuple[tuple[str, Any], ...] = ()

    def sequences(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return sequences(spark.read.parquet(f"{sf_dir}/{self.table}.parquet"), *TEXTS[self.table], self.sigma)

    def samples(self, spark: SparkSession, sf_dir: str, **options: Any) -> DataFrame:
        return sample(self.sequences(spark, sf_dir), get_scheme(self.scheme, **dict(self.params)), self.w, self.k, self.sigma, **options)

    def sql(self) -> str:
        return oracle.sample_sql(oracle.sequence_sql(self.table, *TEXTS[self.table], self.sigma), get_scheme(self.scheme, **dict(self.params)), self.w, self.k, self.sigma)


def grid(table: str, scheme: str, w: int, k: int, sigma: int = 256, **params: Any) -> Grid:
    return Grid(table, scheme, w, k, sigma, tuple(params.items()))


_RANKS = tuple((i * 37 + 11) % 64 for i in range(64))

#: Densities by name. The most used schemes run over documents, the rest over the smaller benchmark table.
DENSITIES = {
    "density_random": grid("documents", "Random", 8, 4),
    "density_lex": grid("documents", "Lex", 8, 4),
    "density_antilex": grid("documents", "AntiLex", 8, 4),
    "density_mod": grid("documents", "Random", 8, 12, mod=1, r=4),
    "density_random_w64": grid("documents", "Random", 64, 8),
    "density_open_documents": grid("documents", "OpenClosed", 8, 8, r=4, open=1),
    "density_alternating": grid("benchmark", "Alternating", 8, 4),
    "density_abb": grid("benchmark", "ABB", 8, 4, 4),
    "density_abb_coded": grid("benchmark", "ABB", 8, 4, 4, coded=1),
    "density_abb2": grid("benchmark", "ABB2", 8, 4, 4),
    "density_abb2_coded": grid("benchmark", "ABB2", 8, 4, coded=1),
    "density_thr_abb": grid("benchmark", "ThresholdABB", 8, 6, thr=100),
    "density_thr_abb2": grid("benchmark", "ThresholdABB2", 8, 6, thr=100),
    "density_t2": grid("benchmark", "T2", 8, 6, thr=110),
    "density_thresholds": grid("benchmark", "Thresholds", 8, 6, thr=40),
    "density_rc_antilex": grid("benchmark", "RcAntiLex", 8, 6, 4),
    "density_rc_antilex_letters": grid("benchmark", "RcAntiLex", 8, 6, 4, letters=1),
    "density_rc_antilex_max": grid("benchmark", "RcAntiLexMax", 8, 6, 4),
    "density_rc_antilex_max_letters": grid("benchmark", "RcAntiLexMax", 8, 6, 4, letters=1),
    "density_lr": grid("benchmark", "Random", 8, 16, mod=1, r=4, lr=1),
    "density_mod_t": grid("benchmark", "Random", 8, 12, mod=1, sampling=5),
    "density_mod_antilex": grid("benchmark", "AntiLex", 8, 12, mod=1, r=4),
    "density_open": grid("benchmark", "OpenClosed", 8, 8, r=4, open=1),
    "density_closed": grid("benchmark", "OpenClosed", 8, 8, r=4, closed=1),
    "density_open_closed": grid("benchmark", "OpenClosed", 8, 8, r=4, open=1, closed=1),
    "density_open_closed_tmer": grid("benchmark", "OpenClosed", 8, 8, r=4, open=1, closed=1, open_tmer=1, closed_tmer=1, other_tmer=1),
    "density_open_modulo": grid("benchmark", "OpenClosed", 4, 12, r=4, open=1, closed=1, modulo=1),
    "density_open_offset_anti": grid("benchmark", "OpenClosed", 8, 8, r=4, open=1, offset=1, anti_tmer=1),
    "density_open_closed_antilex": grid("benchmark", "OpenClosed", 8, 8, r=4, open=1, closed=1, anti_lex=1),
    "density_miniception": grid("benchmark", "Miniception", 8, 12, r=4),
    "density_decycling": grid("benchmark", "Decycling", 8, 6, 4),
    "density_double_decycling": grid("benchmark", "DoubleDecycling", 8, 6, 4),
    "density_rot": grid("benchmark", "Rot", 4, 8, 4),
    "density_altrot": grid("benchmark", "AltRot", 4, 8, 4),
    "density_fracmin": grid("benchmark", "FracMin", 8, 6, f=4),
    "density_fracmin_coded": grid("benchmark", "FracMin", 8, 6, coded=1, f=4),
    "density_threshold": grid("benchmark", "Threshold", 8, 5, t=100, h=1),
    "density_threshold_loose": grid("benchmark", "Threshold", 8, 5, t=100, h=2, loose=1),
    "density_threshold_open": grid("benchmark", "Threshold", 8, 5, t=100, h=1, open=1),
    "density_explicit_order": grid("benchmark", "Bruteforce", 4, 3, 4, ranks=_RANKS),
    "density_directed": grid("benchmark", "Directed", 4, 3, 4, ranks=tuple(r % 40 for r in _RANKS), last=tuple(i % 3 % 2 for i in range(64))),
    "density_greedy_order": grid("benchmark", "Greedy", 5, 3, 4, ranks=(5, 2, 7, 0, 3, 6, 1, 4)),
    "density_templates": grid("benchmark", "Templates", 6, 4, 2, patterns=("_011", "<10", ">01", "0")),
    "sus_lex": grid("benchmark", "SusLex", 8, 2),
    "sus_alternating": grid("benchmark", "SusAlternating", 8, 2),
    "sus_abb": grid("benchmark", "SusABB", 8, 2, 4),
    "sus_abb2": grid("benchmark", "SusABB2", 8, 2, 4),
    "sus_thr_abb": grid("benchmark", "SusThresholdABB", 8, 2, thr=100),
    "sus_thr_abb2": grid("benchmark", "SusThresholdABB2", 8, 2, thr=100),
    "sus_antilex": grid("documents", "SusAntiLex", 8, 2),
    "sus_random_lex": grid("benchmark", "SusRandomLex", 8, 2, seed=8797977),
    "bd_anchor_r0": grid("benchmark", "BdAnchor", 8, 1, r=0),
    "bd_anchor_r1": grid("benchmark", "BdAnchor", 8, 2, r=1),
    "bd_anchor_r2": grid("benchmark", "BdAnchor", 8, 2, r=2),
    "bd_anchor_r3": grid("benchmark", "BdAnchor", 8, 2, r=3),
    "sus_abb2_w64": grid("benchmark", "SusABB2", 64, 4),
    "sus_antilex_w256": grid("documents", "SusAntiLex", 256, 2),
    "bd_anchor_w64": grid("benchmark", "BdAnchor", 64, 4, r=8),
    "bd_anchor_w256": grid("documents", "BdAnchor", 256, 2, r=3),
}

#: Those whose windows are too wide for DuckDB on whole tables; tests hold them against plain loops.
WIDE = ("sus_antilex_w256", "bd_anchor_w256")


def _density(g: Grid) -> Query:
    return lambda spark, d: folds.density(g.sequences(spark, d), get_scheme(g.scheme, **dict(g.params)), g.w, g.k, g.sigma)


_BASE = grid("documents", "Random", 8, 4)
_SMALL = grid("benchmark", "AntiLex", 8, 4)
_BACK = grid("benchmark", "BdAnchor", 8, 2, r=1)


def _samples_with_letters(g: Grid, spark: SparkSession, d: str) -> DataFrame:
    """Samples with the letters of their windows."""
    return g.samples(spark, d, letters=True)


#: (scheme, w, k, sigma, parameters, forward): exact densities; a scheme that isn't forward needs a longer circle.
EXACT = [(n, w, k, s, {}, True) for n in ("Lex", "AntiLex", "Alternating") for w, k, s in ((2, 2, 2), (3, 2, 2), (2, 3, 2), (3, 3, 2), (4, 2, 2), (5, 3, 2), (2, 2, 3), (3, 2, 3), (3, 1, 4))]
EXACT += [("SusLex", 6, 1, 2, {}, True), ("SusAntiLex", 8, 1, 2, {}, True), ("BdAnchor", 4, 1, 2, {"r": 0}, False), ("BdAnchor", 4, 1, 2, {"r": 1}, False)]

#: Optima that searches here have found: w, k, sigma, numerator, denominator.
OPTIMA = [(2, 2, 2, 11, 16), (3, 2, 2, 16, 32), (2, 3, 2, 20, 32), (4, 2, 2, 25, 64)]

BOUNDS = [(w, k, s) for w in range(2, 13) for k in range(1, 9) for s in (2, 3, 4)]

#: Seeds of the random prefix order that are compared.
SEEDS = list(range(1000))
_SEEDS = grid("benchmark", "SusRandomLex", 8, 1, 4)

_CYCLES = grid("benchmark", "AntiLex", 4, 2, 4)
_CYCLE = 10


def exact_densities(spark: SparkSession, _: str) -> DataFrame:
    out = None
    for name, w, k, s, p, forward in EXACT:
        row = debruijn.exact_density(spark, name + "".join(map(str, p.values())), get_scheme(name, **p), w, k, s, forward)
        out = row if out is None else out.unionByName(row)
    return out


def _grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOUNDS, "w int, k int, sigma int")


def _choices(sigma: int, l: int, w: int) -> list[tuple[int, int]]:
    return [(c, (c * 7 + 3) % w) for c in range(sigma**l)]


def selections(spark: SparkSession, _: str) -> DataFrame:
    """Exact densities of all selection functions over two letters, for w 7."""
    out = None
    for name, f in explore.SELECTIONS.items():
        row = search.exact_total(search.exact_counts(spark, f, 2, 7)).select(F.lit(name).alias("selection"), "n_sampled", "n_places")
        out = row if out is None else out.unionByName(row)
    return out


def fasta_density(spark: SparkSession, d: str) -> DataFrame:
    """Densities of documents, written as FASTA of four letters and read again in splits as pieces, whatever the lengths."""
    path = sinks.shared_folder(spark)
    sinks.write_fasta(spelled(_BASE.sequences(spark, d), b"ACGT"), path)
    return folds.density_of_pieces(file_pieces(spark, path, "fasta", 1 << 22), get_scheme("Random"), 8, 4)


def stream_samples(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark's samples from a stream: each text arrives in three parts, and the stream is stopped and started again after each."""
    root = sinks.shared_folder(spark)
    spark.conf.set(*STORE)
    texts, n = _SMALL.sequences(spark, d), F.length("bytes")
    for i in range(3):
        at = F.floor(n * i / 3).cast("int")
        part = texts.select("seq_id", at.cast("long").alias("at"), F.substring("bytes", at + 1, F.floor(n * (i + 1) / 3).cast("int") - at).alias("data"))
        part.write.mode("append").parquet(f"{root}/pieces")
        pieces = spark.readStream.schema(part.schema).parquet(f"{root}/pieces")
        out = sample_stream(pieces, get_scheme("AntiLex"), 8, 4).writeStream.format("parquet").option("checkpointLocation", f"{root}/state")
        out.trigger(availableNow=True).start(f"{root}/samples").awaitTermination()
    return spark.read.parquet(f"{root}/samples").select("seq_id", "win", "pos")


def letter_sums(kmers: np.ndarray) -> np.ndarray:
    """An order of a user's own: k-mers by the sum of their letters."""
    return kmers.sum(axis=1, dtype=np.int64)


def last_largest(windows: np.ndarray) -> np.ndarray:
    """A scheme of a user's own: the last of the greatest letters among the first eight."""
    return 7 - np.argmax(windows[:, 7::-1], axis=1)


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    """Records of three schemes by w and k, positions and all, flat: one row for each number."""
    found = sinks.evaluate(_SMALL.sequences(spark, d), [("Lex", {}), ("Random", {"mod": 1, "r": 2}), ("SusAntiLex", {})], (4, 8), (2, 5), full=True)
    cell = ["tp.minimizer_type", "w", "k"]
    lists = {"place": ("positions", "place", None), "jump": ("dists", "jump", None), "transfer": ("transfer", "place_from", "place_to")}
    out = found.select(*cell, F.lit("density").alias("stat"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.round("density", 9).alias("n"))
    for stat, (column, a, b) in lists.items():
        rows = found.select(*cell, F.explode(column).alias("x"))
        out = out.unionByName(rows.select(*[c.split(".")[-1] for c in cell], F.lit(stat).alias("stat"), F.col(f"x.{a}").alias("a"), (F.col(f"x.{b}") if b else F.lit(0).cast("long")).alias("b"), F.col("x.n").cast("double").alias("n")))
    return out


#: The grid: schemes by w and k, over documents.
GRID_SCHEMES, GRID_W, GRID_K = ("Random", "Lex", "AntiLex", "Alternating"), (4, 8, 12, 24), (2, 4, 6, 10)


def grid_cells() -> list[Cell]:
    return [Cell(name, get_scheme(name), w, k) for name in GRID_SCHEMES for w in GRID_W for k in GRID_K]


def rolling(spark: SparkSession, d: str) -> DataFrame:
    """The least density up to each k, all k from one reading."""
    cells = [Cell("AntiLex", get_scheme("AntiLex"), _SMALL.w, k) for k in range(1, 7)]
    out = grid_density(_SMALL.sequences(spark, d), cells).select("scheme", "k", (F.col("n_changes") / F.col("n_windows")).alias("density"))
    return stats.rolling_min(out, "scheme", "k", "density").select("scheme", "k", F.round("density", 9).alias("density"), F.round("least_so_far", 9).alias("least_so_far"))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: _density(g) for name, g in DENSITIES.items()}
    out |= {
        "fasta_density": fasta_density,
        "stream_samples": stream_samples,
        "evaluate_grid": evaluated,
        "density_user_keys": lambda s, d: folds.density(_BASE.sequences(s, d), user_scheme(keys=letter_sums), 8, 4),
        "density_user_places": lambda s, d: folds.density(_BASE.sequences(s, d), user_scheme(places=last_largest), 8, 4),
        "density_search_winner": lambda s, d: folds.density(_SMALL._replace(sigma=2).sequences(s, d), search.winner(search.best_order(s, 3, 2, 2, True).first(), 2, 2), 3, 2, 2),
        "all_stats": lambda s, d: run_stats(_BASE.sequences(s, d), get_scheme("Random"), 8, 4),
        "grid_density": lambda s, d: grid_density(_BASE.sequences(s, d), grid_cells()),
        "density_total": lambda s, d: folds.density(_BASE.sequences(s, d), get_scheme(_BASE.scheme), _BASE.w, _BASE.k, by=()),
        "density_rightmost": lambda s, d: folds.density(_SMALL.sequences(s, d), get_scheme("ThresholdABB", thr=100)._replace(rightmost=True), 8, 4),
        "distinct_positions": lambda s, d: folds.distinct_positions(_BASE.sequences(s, d), get_scheme("Random"), 8, 4),
        "distinct_positions_bd_anchor": lambda s, d: folds.distinct_positions(_BACK.sequences(s, d), get_scheme("BdAnchor", r=1), 8, 2),
        "hist_positions": lambda s, d: stats.positions(_BASE.samples(s, d)),
        "hist_distances": lambda s, d: stats.distances(_BACK.samples(s, d)),
        "transfer_matrix": lambda s, d: stats.transfer(_BASE.samples(s, d)),
        "kmer_counts": lambda s, d: stats.sampled_kmers(_samples_with_letters(_SMALL, s, d), 4),
        "kmer_pos_hist": lambda s, d: stats.kmer_places(_samples_with_letters(_SMALL, s, d), 4),
        "kmer_jumps": lambda s, d: stats.kmer_jumps(_samples_with_letters(_SMALL, s, d), 4),
        "range_check": lambda s, d: stats.out_of_range(_BASE.samples(s, d), 8).select("seq_id", "win", "pos"),
        "is_forward": lambda s, d: stats.is_forward(_BACK.samples(s, d)),
        "interval_merge": lambda s, d: coverage.covered(_SMALL.sequences(s, d), get_scheme("AntiLex"), 8, 4),
        "interval_merge_documents": lambda s, d: coverage.covered(_BASE.sequences(s, d), get_scheme("AntiLex"), 24, 4),
        "seed_counts": lambda s, d: search.compare_seeds(_SEEDS.sequences(s, d), _SEEDS._replace(sigma=2).sequences(s, d), SEEDS[:10], 8, 1, 4),
        "best_seed": lambda s, d: search.best_seed(search.compare_seeds(_SEEDS.sequences(s, d), _SEEDS._replace(sigma=2).sequences(s, d), SEEDS, 8, 1, 4)),
        "seed_table": lambda s, d: search.seed_table(_SEEDS.sequences(s, d), SEEDS[:4], [2, 4, 8, 16], 1, 4),
        "context_diff": lambda s, d: stats.only_in(stats.contexts(_samples_with_letters(_SMALL, s, d)), stats.contexts(_samples_with_letters(_SMALL._replace(scheme="Lex"), s, d))),
        "context_sides": lambda s, d: stats.differing(stats.contexts(_samples_with_letters(_SMALL, s, d)), stats.contexts(_samples_with_letters(_BACK._replace(k=4), s, d))),
        "samples_all": lambda s, d: _SMALL.samples(s, d).select("seq_id", "win", "pos"),
        "scheme_report": lambda s, d: stats.scheme_report(_BACK.samples(s, d)),
        "rank_listing": lambda s, d: search.rank_listing(s.createDataFrame([(i, r % 40) for i, r in enumerate(_RANKS)], "code long, rank long")),
        "mean_jumps": lambda s, d: stats.mean_jumps(stats.kmer_jumps(_samples_with_letters(_SMALL, s, d), 4)),
        "transfer_power": lambda s, d: stats.transfer_power(stats.transfer(_SMALL.samples(s, d))).select("place_from", "place_to", F.round("p", 6).alias("p")),
        "cycle_stats": lambda s, d: stats.cycle_stats(stats.cycle_samples(_CYCLES.sequences(s, d), _CYCLE, get_scheme("AntiLex"), 4, 2, 4)),
        "bad_cycles": lambda s, d: stats.bad_cycles(_CYCLES.sequences(s, d), _CYCLE, get_scheme("AntiLex"), 4, 2, 4),
        "explicit_scheme": lambda s, d: explicit_local(_CYCLES.sequences(s, d), s.createDataFrame(_choices(4, 5, 4), "code long, choice int"), 4, 2, 4),
        "window_ratio": lambda s, d: search.window_ratio(_samples_with_letters(_SMALL, s, d), "(6561|20..)", 2, 8),
        "rolling_min_density": rolling,
        "debruijn_words": lambda s, d: debruijn.lyndon_words(s, 2, 8),
        "debruijn_sequence": lambda s, d: debruijn.de_bruijn(s, 2, 3).unionByName(debruijn.de_bruijn(s, 3, 2)),
        "cyclic_density_exact": exact_densities,
        "bounds_grid": lambda s, d: bounds.add_bounds(_grid(s)).select("w", "k", "sigma", *[F.round(c, 9).alias(c) for c in ("trivial", "expected", "sampled_kmers", "older", "older_improved", "lower", "lower_next", "lower_smooth")]),
        "bounds_counted": lambda s, d: bounds.counted_bound(s, 4, 4, 3),
        "optimum_vs_bound": lambda s, d: bounds.against_optima(bounds.exact_bounds(s, BOUNDS), s.createDataFrame(OPTIMA, "w int, k int, sigma int, num long, den long")),
        "bruteforce_orders": lambda s, d: search.best_order(s, 3, 3, 2),
        "bruteforce_directed": lambda s, d: search.best_order(s, 3, 2, 2, True),
        "bruteforce_local": lambda s, d: search.best_local(s, 2, 2, 2),
        "selection_densities": selections,
        "failing_cycles": lambda s, d: search.failing_cycles(search.exact_counts(s, explore.sus, 2, 7)),
        "suffix_minimal_words": lambda s, d: search.suffix_minimal(s, 2, 8),
    }
    return out


def _words_sql(sigma: int, n: int) -> str:
    digits = " || ".join(f"CAST((c // {sigma ** (n - 1 - i)}) % {sigma} AS VARCHAR)" for i in range(n))
    return f"SELECT {digits} AS word FROM range({sigma**n}) t(c)"


def _lyndon_sql(sigma: int, n: int) -> str:
    return f"SELECT word FROM ({_words_sql(sigma, n)}) WHERE len(list_filter(range(1, {n}), lambda i: word >= substring(word, i + 1) || substring(word, 1, i))) = 0"


def _cycles_sql() -> str:
    """Samples of each whole chunk of _CYCLE letters, with a window's letters once more at its end."""
    texts = oracle.sequence_sql(_CYCLES.table, *TEXTS[_CYCLES.table], _CYCLES.sigma)
    size = 2 * _CYCLE
    parts = f"SELECT seq_id * 1000000 + c AS seq_id, substring(h, c * {size} + 1, {size}) AS h FROM (SELECT seq_id, h, unnest(range(0, length(h) // {size})) AS c FROM ({texts}))"
    l = _CYCLES.w + _CYCLES.k - 1
    return oracle.sample_sql(f"SELECT seq_id, h || substring(h, 1, {2 * l - 2}) AS h FROM ({parts})", get_scheme(_CYCLES.scheme), _CYCLES.w, _CYCLES.k, _CYCLES.sigma)


def _runs_sql(seed: int, w: int, sigma: int) -> str:
    """Places that anchors by the random prefix order of a seed sample in benchmark, and windows."""
    g = _SEEDS._replace(w=w, sigma=sigma, params=(("seed", seed),))
    return g.sql() + "SELECT count(*) FILTER (prev IS NULL OR pos <> prev) AS n, count(*) AS n_windows FROM smp"


def _evaluated_sql(name: str, w: int, k: int, p: dict[str, Any]) -> str:
    head, jump = f"SELECT '{name}' AS minimizer_type, {w} AS w, {k} AS k,", "pos - coalesce(prev, 0)"
    return f"""SELECT * FROM ({_SMALL._replace(scheme=name, w=w, k=k, params=tuple(p.items())).sql()}
        {head} 'density' AS stat, 0::BIGINT AS a, 0::BIGINT AS b, round(count(*) FILTER ({oracle.CHANGED}) / count(*), 9) AS n FROM smp
        UNION ALL {head} 'place', pos - win, 0, count(*) FROM smp GROUP BY pos - win
        UNION ALL {head} 'jump', {jump}, 0, count(*) FROM smp WHERE {oracle.CHANGED} GROUP BY {jump}
        UNION ALL {head} 'transfer', prev - win + 1, pos - win, count(*) FROM smp WHERE prev IS NOT NULL GROUP BY prev - win + 1, pos - win)"""


def best_directed(w: int, k: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Ranks and sides of the directed order of words of k digits 0 and 1 with the fewest samples on the circle, the first in the order of the search, by plain loops."""
    n, text = 2**k, debruijn.de_bruijn_text(2, w + k)
    codes = [int((text + text)[i : i + k], 2) for i in range(len(text))]
    best: tuple | None = None
    for number in range(math.factorial(n)):
        ranks = search.permutation(number, n)
        for way in range(2**n):
            taken = set()
            for i in range(len(text)):
                window = [codes[(i + j) % len(text)] for j in range(w)]
                least = min(window, key=lambda c: ranks[c])
                taken.add((i + (w - 1 - window[::-1].index(least) if way >> least & 1 else window.index(least))) % len(text))
            if best is None or len(taken) < best[0]:
                best = len(taken), tuple(ranks), tuple(way >> j & 1 for j in range(n))
    return best[1:]


def _exact_sql(case: tuple) -> str:
    """Over the circle itself, written out, with the window's letters once more at its end."""
    name, w, k, s, p, forward = case
    size = s ** debruijn.exact_order(w, k, forward)
    text = debruijn.de_bruijn_text(s, debruijn.exact_order(w, k, forward))
    ring = "".join(f"0{c}" for c in text + text[: w + k - 2])
    body = oracle.sample_sql(f"SELECT 0 AS seq_id, '{ring}' AS h", get_scheme(name, **p), w, k, s)
    return f"SELECT * FROM ({body} SELECT '{name}{''.join(map(str, p.values()))}' AS scheme, {w} AS w, {k} AS k, {s} AS sigma, {size}::BIGINT AS n_text, count(DISTINCT pos % {size}) AS n_sampled FROM smp)"


def optimum_sql(optima: list[tuple[int, int, int, int, int]]) -> str:
    """Whether optima (w, k, sigma, num, den) equal their bounds, which come from the least periods of all circles of digits, numbers to the base sigma."""
    return f"""WITH o(w, k, sigma, num, den) AS (VALUES {", ".join(map(str, optima))}),
    l AS (SELECT DISTINCT w, k, sigma, unnest([w + k, w + ((k - 2 + w) // w) * w + 1])::INT AS n FROM o),
    d AS (SELECT *, unnest(list_filter(range(1, n + 1), lambda d: n % d = 0)) AS d FROM l),
    s AS (SELECT *, pow(sigma, d)::BIGINT AS head, pow(sigma, n - d)::BIGINT AS tail, unnest(range(0, pow(sigma, n)::BIGINT)) AS x FROM d),
    t AS (SELECT w, k, sigma, n, x, min(d) AS p FROM s WHERE x % tail * head + x // tail = x GROUP BY w, k, sigma, n, x),
    c AS (SELECT w, k, sigma, n, p, count(*) AS words FROM t GROUP BY w, k, sigma, n, p),
    b AS (SELECT w, k, sigma, pow(sigma, n)::BIGINT AS b_den, sum(words // p * ((p + w - 1) // w))::BIGINT AS b_num FROM c GROUP BY w, k, sigma, n)
    SELECT w::INT AS w, k::INT AS k, sigma::INT AS sigma, bool_or(b_num * den = num * b_den) AND bool_and(b_num * den <= num * b_den) AS tight
    FROM o JOIN b USING (w, k, sigma) GROUP BY w, k, sigma"""


def sql() -> dict[str, str]:
    out = {name: oracle.density_sql(g.sql()) for name, g in DENSITIES.items() if name not in WIDE}
    low = lambda at: "(" + " + ".join(f"(instr('0123456789ABCDEF', substring(h, 2 * {at} + {2 * i + 2}, 1)) - 1) % 2 * {2 ** (3 - i)}" for i in range(4)) + ")::BIGINT"
    jump = "pos - coalesce(prev, 0)"
    right = oracle.sample_sql(oracle.sequence_sql("benchmark", "item_id", "text", 256), get_scheme("ThresholdABB", thr=100)._replace(rightmost=True), 8, 4, 256)
    merged = """, iv AS (SELECT DISTINCT seq_id, pos AS first, pos + 4 AS past FROM smp),
            mk AS (SELECT *, CASE WHEN first <= max(past) OVER (PARTITION BY seq_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM iv),
            il AS (SELECT *, sum(new) OVER (PARTITION BY seq_id ORDER BY first) AS island FROM mk)
            SELECT seq_id, min(first) AS first, max(past) AS past FROM il GROUP BY seq_id, island"""
    ctx = "SELECT DISTINCT substring(h, 2 * win - 1, 24) AS context FROM smp WHERE prev IS NOT NULL AND pos <> prev"
    out |= {
        "fasta_density": oracle.density_sql(
            oracle.sample_sql(f"SELECT seq_id::VARCHAR AS seq_id, hex(encode(translate(regexp_replace(h, '0(.)', '\\1', 'g'), '0123', 'ACGT'))) AS h FROM ({oracle.sequence_sql('documents', 'doc_id', 'text', 4)})", get_scheme("Random"), 8, 4, 256)
        ),
        "all_stats": _BASE.sql() + f""", y AS MATERIALIZED (SELECT seq_id, win, pos, prev FROM smp),
            c AS MATERIALIZED (SELECT seq_id, p, {low_bits('x', 4)} AS code FROM (SELECT seq_id, p, substring(h, 2 * p + 1, 8) AS x FROM (SELECT seq_id, h, unnest(range(0, n - 3)) AS p FROM s))),
            x AS MATERIALIZED (SELECT win, pos, prev, c.code, d.code AS code_before FROM y JOIN c ON c.seq_id = y.seq_id AND c.p = pos LEFT JOIN c AS d ON d.seq_id = y.seq_id AND d.p = prev)
            SELECT 'windows' AS stat, 0::BIGINT AS a, 0::BIGINT AS b, count(*) AS n FROM x
            UNION ALL SELECT 'changes', 0, 0, count(*) FROM x WHERE {oracle.CHANGED}
            UNION ALL SELECT 'pos_sum', 0, 0, sum(pos)::BIGINT FROM x
            UNION ALL SELECT 'runs', 0, 0, count(*) FROM x WHERE prev IS NULL OR pos <> prev
            UNION ALL SELECT 'back', 0, 0, count(*) FROM x WHERE pos < prev
            UNION ALL SELECT 'outside', 0, 0, count(*) FROM x WHERE pos < win OR pos >= win + 8
            UNION ALL SELECT 'place', pos - win, 0, count(*) FROM x GROUP BY pos - win
            UNION ALL SELECT 'jump', {jump}, 0, count(*) FROM x WHERE {oracle.CHANGED} GROUP BY {jump}
            UNION ALL SELECT 'transfer', prev - win + 1, pos - win, count(*) FROM x WHERE prev IS NOT NULL GROUP BY prev - win + 1, pos - win
            UNION ALL SELECT 'kmer', code, 0, count(*) FROM x WHERE {oracle.CHANGED} GROUP BY 2
            UNION ALL SELECT 'kmer_place', code, pos - win, count(*) FROM x GROUP BY 2, 3
            UNION ALL SELECT 'jump_to', code, pos - prev, count(*) FROM x WHERE pos > prev GROUP BY 2, 3
            UNION ALL SELECT 'jump_from', code_before, pos - prev, count(*) FROM x WHERE pos > prev GROUP BY 2, 3""",
        "grid_density": oracle.grid_sql(oracle.sequence_sql("documents", "doc_id", "text", 256), [(n, get_scheme(n)) for n in GRID_SCHEMES], GRID_W, GRID_K),
        "density_total": oracle.density_sql(_BASE.sql(), ""),
        "density_rightmost": oracle.density_sql(right),
        "distinct_positions": _BASE.sql() + "SELECT seq_id, count(DISTINCT pos) AS n_sampled FROM smp GROUP BY seq_id",
        "distinct_positions_bd_anchor": _BACK.sql() + "SELECT seq_id, count(DISTINCT pos) AS n_sampled FROM smp GROUP BY seq_id",
        "hist_positions": _BASE.sql() + "SELECT pos - win AS place, count(*) AS n FROM smp GROUP BY 1",
        "hist_distances": _BACK.sql() + f"SELECT {jump} AS jump, count(*) AS n FROM smp WHERE {oracle.CHANGED} GROUP BY 1",
        "transfer_matrix": _BASE.sql() + "SELECT prev - win + 1 AS place_from, pos - win AS place_to, count(*) AS n FROM smp WHERE prev IS NOT NULL GROUP BY 1, 2",
        "kmer_counts": _SMALL.sql() + f"SELECT {low('pos')} AS kmer, count(*) AS n FROM smp WHERE {oracle.CHANGED} GROUP BY 1",
        "kmer_pos_hist": _SMALL.sql() + f"SELECT {low('pos')} AS kmer, pos - win AS place, count(*) AS n FROM smp GROUP BY 1, 2",
        "kmer_jumps": _SMALL.sql() + f", j AS (SELECT {low('pos')} AS kmer, pos - prev AS jump, 1 AS t FROM smp WHERE pos > prev UNION ALL SELECT {low('prev')}, pos - prev, 0 FROM smp WHERE pos > prev) SELECT kmer, jump, sum(t)::BIGINT AS n_to, sum(1 - t)::BIGINT AS n_from FROM j GROUP BY 1, 2",
        "range_check": _BASE.sql() + "SELECT seq_id, win, pos FROM smp WHERE pos < win OR pos >= win + 8",
        "is_forward": _BACK.sql() + "SELECT seq_id, coalesce(bool_and(pos >= prev), true) AS forward FROM smp GROUP BY seq_id",
        "interval_merge": _SMALL.sql() + merged,
        "interval_merge_documents": _BASE._replace(scheme="AntiLex", w=24).sql() + merged,
        "seed_counts": " UNION ALL ".join(f"SELECT {seed}::BIGINT AS seed, a.n AS n_first, b.n AS n_second, a.n_windows FROM ({_runs_sql(seed, 8, 4)}) a, ({_runs_sql(seed, 8, 2)}) b" for seed in SEEDS[:10]),
        "seed_table": " UNION ALL ".join(f"SELECT {w} AS w, {seed}::BIGINT AS seed, n, n_windows * {-(-(w + 1) // w)} // {w + 1} AS least, n - n_windows * {-(-(w + 1) // w)} // {w + 1} AS extra FROM ({_runs_sql(seed, w, 4)})" for w in (2, 4, 8, 16) for seed in SEEDS[:4]),
        "transfer_power": _SMALL.sql() + """, t AS (SELECT prev - win + 1 AS f, pos - win AS t, count(*) AS n FROM smp WHERE prev IS NOT NULL GROUP BY 1, 2),
            m1 AS (SELECT f, t, n / sum(n) OVER (PARTITION BY f) AS p FROM t),
            m2 AS (SELECT a.f, b.t, sum(a.p * b.p) AS p FROM m1 a JOIN m1 b ON a.t = b.f GROUP BY a.f, b.t),
            m4 AS (SELECT a.f, b.t, sum(a.p * b.p) AS p FROM m2 a JOIN m2 b ON a.t = b.f GROUP BY a.f, b.t),
            m8 AS (SELECT a.f, b.t, sum(a.p * b.p) AS p FROM m4 a JOIN m4 b ON a.t = b.f GROUP BY a.f, b.t)
            SELECT f AS place_from, t AS place_to, round(p, 6) AS p FROM m8""",
        "bad_cycles": f"""SELECT word, min(samples) AS samples FROM (SELECT least[1] AS word,
            array_to_string(list_sort(list_transform(p, lambda x: (x + {_CYCLE} - CAST(least[2] AS INT)) % {_CYCLE})), ',') AS samples
            FROM (SELECT p, list_sort(list_transform(range(0, {_CYCLE}), lambda i: [substring(h || h, 2 * i + 1, {2 * _CYCLE}), CAST(i AS VARCHAR)]))[1] AS least
            FROM (SELECT seq_id, any_value(substring(h, 1, {2 * _CYCLE})) AS h, list(DISTINCT pos % {_CYCLE}) AS p FROM ({_cycles_sql()} SELECT * FROM smp) GROUP BY seq_id HAVING count(DISTINCT pos % {_CYCLE}) > {-(-_CYCLE // _CYCLES.w)})))
            GROUP BY word""",
        "context_diff": "SELECT context FROM (" + _SMALL.sql() + ctx + ") EXCEPT SELECT context FROM (" + _SMALL._replace(scheme="Lex").sql() + ctx + ")",
        "evaluate_grid": " UNION ALL ".join(_evaluated_sql(n, w, k, p) for n, p in (("Lex", {}), ("Random", {"mod": 1, "r": 2}), ("SusAntiLex", {})) for w in (4, 8) for k in (2, 5)),
        "density_user_keys": oracle.density_sql(oracle.sample_sql(oracle.sequence_sql("documents", "doc_id", "text", 256), Scheme(lambda dialect, x, s: dialect.number(strided_sum(x, s.k, 0, 1), 8)), 8, 4, 256)),
        "density_user_places": oracle.density_sql(oracle.sample_sql(oracle.sequence_sql("documents", "doc_id", "text", 256), Scheme(lambda dialect, x, s: complement(part(x, 0, 1)), rightmost=True), 8, 4, 256)),
        "density_search_winner": oracle.density_sql(oracle.sample_sql(oracle.sequence_sql("benchmark", "item_id", "text", 2), Scheme(explicit_directed(*best_directed(3, 2)), sided=True), 3, 2, 2)),
        "context_sides": f"""WITH a AS ({_SMALL.sql()} {ctx}), b AS ({_BACK._replace(k=4).sql()} SELECT DISTINCT substring(h, 2 * win - 1, 24) AS context FROM smp WHERE prev IS NOT NULL AND pos <> prev)
            SELECT context, 'left' AS side FROM a WHERE context NOT IN (SELECT context FROM b) UNION ALL SELECT context, 'right' FROM b WHERE context NOT IN (SELECT context FROM a)""",
        "stream_samples": _SMALL.sql() + "SELECT seq_id, win, pos FROM smp",
        "samples_all": _SMALL.sql() + "SELECT seq_id, win, pos FROM smp",
        "scheme_report": _BACK.sql() + f"SELECT count(*) AS n_windows, sum(CASE WHEN {oracle.CHANGED} THEN 1 ELSE 0 END)::BIGINT AS n_changes, sum(pos)::BIGINT AS pos_sum, bool_and(coalesce(pos >= prev, true)) AS forward FROM smp",
        "rank_listing": "SELECT code, rank FROM (SELECT i::BIGINT AS code, ((i * 37 + 11) % 64 % 40)::BIGINT AS rank FROM range(64) t(i)) WHERE rank < 39",
        "mean_jumps": _SMALL.sql() + f"SELECT {low('pos')} AS kmer, count(*) AS n, sum(pos - prev)::BIGINT AS jump_sum FROM smp WHERE pos > prev GROUP BY 1",
        "window_ratio": _SMALL.sql() + """SELECT count(*) AS windows, sum(CASE WHEN regexp_full_match(substring(h, 2 * pos + 1, 4), '6561|20..') THEN 1 ELSE 0 END)::BIGINT AS chosen FROM smp
            WHERE len(list_filter(range(0, 8), lambda j: regexp_full_match(substring(h, 2 * (win + j) + 1, 4), '6561|20..'))) > 0""",
        "rolling_min_density": "SELECT scheme, k, round(density, 9) AS density, round(least(1, min(density) OVER (ORDER BY k)), 9) AS least_so_far FROM ("
        + " UNION ALL ".join(f"SELECT 'AntiLex' AS scheme, {k} AS k, n_changes / n_windows AS density FROM ({oracle.density_sql(_SMALL._replace(k=k).sql(), '')})" for k in range(1, 7)) + ")",
        "cycle_stats": f"SELECT samples, count(*) AS n FROM ({_cycles_sql()} SELECT seq_id, count(DISTINCT pos % {_CYCLE})::INT AS samples FROM smp GROUP BY seq_id) GROUP BY samples",
        "explicit_scheme": "WITH seqs AS (" + oracle.sequence_sql("benchmark", "item_id", "text", 4) + """), s AS (SELECT seq_id, h, length(h) // 2 AS n FROM seqs WHERE length(h) // 2 >= 5),
            x AS (SELECT seq_id, h, unnest(range(0, n - 4)) AS win FROM s),
            c AS (SELECT seq_id, win, list_sum(list_transform(range(0, 5), lambda i: CAST(substring(h, 2 * win + 2 * i + 2, 1) AS BIGINT) * CAST(pow(4, 4 - i) AS BIGINT)))::BIGINT AS code FROM x)
            SELECT seq_id, win, win + (code * 7 + 3) % 4 AS pos FROM c""",
        "debruijn_words": " UNION ALL ".join(_lyndon_sql(2, n) for n in (1, 2, 4, 8)),
        "debruijn_sequence": "SELECT 2 AS sigma, 3 AS ord, '0001011100' AS seq UNION ALL SELECT 3, 2, '0010211220'",
        "cyclic_density_exact": " UNION ALL ".join(map(_exact_sql, EXACT)),
        "bounds_grid": """WITH g AS (SELECT w::INT AS w, k::INT AS k, sigma::INT AS sigma FROM range(2, 13) a(w), range(1, 9) b(k), (VALUES (2), (3), (4)) c(sigma)),
            n AS (SELECT *, ceil((k - 1) / w) * w + 1 AS j FROM g)
            SELECT w, k, sigma, round(1 / w, 9) AS trivial, round(2 / (w + 1), 9) AS expected, round(pow(sigma, -k), 9) AS sampled_kmers,
            round((1.5::DOUBLE + greatest(floor((k - w) / w), 0) + 1 / (2 * w)) / (w + k), 9) AS older, round(1.5::DOUBLE / (w + k - 0.5::DOUBLE), 9) AS older_improved,
            round(ceil((w + k) / w) / (w + k), 9) AS lower, round(greatest(ceil((w + k) / w) / (w + k), ceil((w + j) / w) / (w + j)), 9) AS lower_next,
            round((w + k + (w - 1)) / w / (w + k), 9) AS lower_smooth FROM n""",
        "bounds_counted": "SELECT sum(ceil(length(word) / 4))::BIGINT AS num, 6561::BIGINT AS den FROM (" + " UNION ALL ".join(_lyndon_sql(3, n) for n in (1, 2, 4, 8)) + ")",
        "optimum_vs_bound": optimum_sql(OPTIMA),
        "suffix_minimal_words": f"SELECT word FROM ({_words_sql(2, 8)}) WHERE len(list_filter(range(2, 9), lambda i: substring(word, i) < word)) = 0",
    }
    return out
