"""Runs that a configuration file of "key value" lines describes: a graph file to memberships, and a bipartite file to embeddings."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import membership, sampler
from quillgraph.sources import memberships, metis
from quillgraph.sources.lines import COMMENT

# The keys of the files, and the names of strategies in them.
SETTINGS = {"K": "clusters", "k": "clusters", "scaleCoeff": "scale", "maxEpoch": "max_epochs", "eps": "least_moves", "evalEvery": "metrics_every", "minClusterSize": "least_size", "maxMembershipsPerVertex": "most_memberships", "runAllEpochs": "all_epochs", "randomSeed": "seed", "divideResultIntoConnectedComponents": "divide", "removeWeakLinksForConnectedComponents": "remove_weak_links", "wtCoeff": "weight", "evalRatio": "evaluated"}
STRATEGIES = {"SingleOrZeroMembershipLikelihood": "single", "MultipleMembershipLikelihood": "multiple", "FractionOfNeighbors": "neighbors", "FractionOfNeighborsAndCluster": "neighbors_and_cluster"}
FILES = "metisFile initFromRowsFile initFromColsFile outputByRowsFile outputByColsFile outputRowsWithScoresFile clusterPrecisionFile outputLeftRepFile outputRightRepFile".split()
STARTS = {"initFromRandomNeighborhood": "random_neighborhood", "initFromBestNeighborhood": "seeds", "initFromNonoverlappingNeighborhood": "uncovered"}
NUMBERS = "thresholdForStepOne thresholdForStepThree thresholdForStepFour topKParameter maxTemperature".split()
SWITCHES = "retainTopK squareWeights normalizeColumnsRight normalizeRowsLeft applyStepFour applyLogTransform useTemperatureSchedule updateImmediately".split()
IGNORED = "noLocking useWeightCoeffForProposal".split()


@dataclass(frozen=True)
class Run:
    """``settings`` of the fit, ``files`` by key, ``options`` of the bipartite pipeline by key, ``unknown`` keys."""

    settings: sampler.Settings
    files: dict[str, str] = field(default_factory=dict)
    options: dict[str, float | bool] = field(default_factory=dict)
    unknown: tuple[str, ...] = ()


def _true(word: str) -> bool:
    return word.lower() == "true"


def parsed(text: str) -> Run:
    """A line is a key and a value; comments and blank lines are skipped. Unknown keys are warned of, unknown strategies give the default.

    A random neighbourhood is the start unless it is switched off; then the best sub-neighbourhoods of random seeds or those of uncovered
    ones, whichever is switched on, else random clusters. Updates that aren't immediate are one batch an epoch; one cpu is a sweep in
    which neighbours see each other's moves: batches by colours."""
    own: dict = {}
    files, options, unknown = {}, {}, []
    starts = {"random_neighborhood": True, "seeds": False, "uncovered": False}
    kinds = {f.name: f.type for f in sampler.Settings.__dataclass_fields__.values()}
    for line in text.splitlines():
        key, _, value = line.strip().partition(" ")
        value = value.strip()
        if not key or key.startswith(COMMENT):
            continue
        if key in SETTINGS:
            name = SETTINGS[key]
            own[name] = _true(value) if kinds[name] == "bool" else float(value) if kinds[name].startswith("float") else int(value)
        elif key == "proposalStrategy":
            own["strategy"] = STRATEGIES.get(value, "single")
        elif key == "cpu":
            own["colours"] = int(value) <= 1
        elif key in FILES:
            files[key] = value
        elif key in STARTS:
            starts[STARTS[key]] = _true(value)
        elif key in NUMBERS:
            options[key] = float(value)
        elif key in SWITCHES:
            options[key] = _true(value)
        elif key not in IGNORED:
            unknown.append(key)
    if unknown:
        warnings.warn(f"unknown keys: {', '.join(unknown)}", stacklevel=2)
    own["start"] = next((name for name, on in starts.items() if on), "random")
    if options.get("useTemperatureSchedule"):
        own["temperature"] = options.get("maxTemperature", 100.0)
    if options.get("updateImmediately") is False:
        own["batches"] = 1
    return Run(sampler.Settings(**own), files, options, tuple(unknown))


def read_config(path: str) -> Run:
    """A small file that the driver reads."""
    with open(path) as f:
        return parsed(f.read())


def _clusters(z: DataFrame) -> DataFrame:
    top = z.agg(F.max("cluster")).first()[0]
    return z.sparkSession.range(0 if top is None else top + 1)


def fit_from_config(spark: SparkSession, run: Run) -> DataFrame:
    """Memberships of the graph file's vertices; those outputs are written that the run names. The precision file must not be there yet."""
    g = metis.read_metis(spark, run.files["metisFile"])
    if "initFromRowsFile" in run.files:
        start = memberships.read_rows(spark, run.files["initFromRowsFile"], g.n_vertices)
    elif "initFromColsFile" in run.files:
        start = memberships.read_columns(spark, run.files["initFromColsFile"])
    else:
        start = sampler.start_from(g.edges, g.vertices, run.settings)
    z = sampler.materialised(sampler.fit(g.edges, g.vertices, run.settings, start), "fitted")
    scored = lambda: membership.affiliations(g.edges, g.vertices, z).select(F.col("vertex").alias("row"), F.col("cluster").alias("col"), F.col("score").alias("value"))
    outputs = {
        "outputByRowsFile": lambda: memberships.row_lines(z, g.vertices),
        "outputByColsFile": lambda: memberships.column_lines(z, _clusters(z)),
        "outputRowsWithScoresFile": lambda: memberships.scored_lines(scored(), g.vertices),
        "clusterPrecisionFile": lambda: memberships.precision_lines(membership.cluster_precision(g.edges, g.vertices, z)),
    }
    for key, rows in outputs.items():
        if key in run.files:
            memberships.write(rows(), run.files[key])
    return z


def embeddings_from_config(spark: SparkSession, run: Run) -> tuple[DataFrame, DataFrame]:
    """(left, right) embeddings of the bipartite file; written with a header if the run names files."""
    g = metis.read_bipartite_metis(spark, run.files["metisFile"])
    o = run.options
    left, right = sampler.bipartite_communities(
        g.edges, run.settings, threshold=o.get("thresholdForStepOne", 0.0), top_k=int(o["topKParameter"]) if o.get("retainTopK") else None, squared=o.get("squareWeights", False), least_edges=int(o.get("thresholdForStepThree", 0)),
        step_four=o.get("applyStepFour", False), log_values=o.get("applyLogTransform", False), normalize_left=o.get("normalizeRowsLeft", False), right_threshold=o.get("thresholdForStepFour", 0.0), normalize_right=o.get("normalizeColumnsRight", False),
    )
    top = left.select("col").unionByName(right.select("col")).agg(F.max("col")).first()[0]
    for key, m, n in (("outputLeftRepFile", left, g.n_left), ("outputRightRepFile", right, g.n_right)):
        if key in run.files:
            memberships.write(memberships.scored_lines(m, spark.range(n), 0 if top is None else top + 1), run.files[key])
    return left, right
