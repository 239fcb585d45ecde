"""Every registered query, as ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.constants import (
    FEATURE_KEYS, GIRLS_16, MATCH_DERIVED, MATCH_SUMS, TOP_FLIGHT,
)
from touchline.operators import classify, cluster, profile
from touchline.operators.boosting import Setting
from touchline.operators.enrich import enrich_events, mark_passes
from touchline.operators.nearest import nearest
from touchline.operators.plays import roll_up_plays
from touchline.operators.sequence import sequence_events
from touchline.operators.slices import stage, workspace
from touchline.plans import conversion, models, reports
from touchline.plans.registry import STATS
from touchline.sources import feed as sources

SEQUENCED_COLUMNS = [
    "gameID", "ord", "eventName", "byUs", "half", "lengthFraction", "lengthMetres",
    "widthFraction", "widthMetres", "playNumber", "sequenceNumber", "player", "usPhase",
    "oppositionPhase", "adjEventName", "adjPass", "attackIncursion", "penaltyIncursion",
    "pseudoEvent"]
ENRICHED_COLUMNS = [
    "gameID", "ord", "pseudoEvent", "kickoff_date", "age_group", "matchName",
    "widthMetres", "widthFraction", "playArea", "maxSequenceNumber",
    "isAttackIncursion", "numberPasses", "isGoal", "playByUs", "firstEvent",
    "lastEvent", "backPassTurnover", "fwdPassTurnover", "sidePassTurnover",
    "rightAttack", "middleAttack", "leftAttack", "isZone14Incursion",
    "isZone17Incursion", "isZone11PassIncursion", "isBackKeeperPass", "Movement"]
SHARE_STATS = [s for s in STATS if STATS[s].kind != "count"]

Query = Callable[[SparkSession, str], DataFrame]
EVENT_KEY = ["gameID", "ord", "pseudoEvent"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zero."""
    return df.selectExpr(*[
        f"round(`{f.name}`, {digits}) + 0D AS `{f.name}`"
        if isinstance(f.dataType, T.DoubleType) else f"`{f.name}`"
        for f in df.schema.fields])


# --- stage tables -----------------------------------------------------------
def feed(spark: SparkSession, sf: str) -> DataFrame:
    return sources.events_feed(spark, sf)


def sequenced(spark: SparkSession, sf: str) -> DataFrame:
    return sequence_events(feed(spark, sf))


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return enrich_events(sequenced(spark, sf))


def plays(spark: SparkSession, sf: str) -> DataFrame:
    return roll_up_plays(enriched(spark, sf))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return profile.labelled_predictors(profile.match_features(plays(spark, sf)))


def teams(spark: SparkSession, sf: str) -> DataFrame:
    """Team profiles of our competition and the top flight (small, reused)."""
    return stage(cluster.dashboard_teams(profile.team_profile(plays(spark, sf))))


#: What the model queries fit: the published grid of forests and folds with fewer
#: trees (the functions' defaults are the published numbers; README has their times).
MODELS = models.Plan(settings=(Setting(3, 5),), boosted_trees=(4, 8),
                     forest_trees=40, forest_batch=40)


# --- event level ------------------------------------------------------------
def feed_events(spark, sf):
    df = feed(spark, sf)
    return rounded(df.drop(*sources.POSSESSION))


def feed_roundtrip(spark, sf):
    """The feed written as pipe-separated files and read back, bad rows caught."""
    folder = f"{workspace(spark)}/feed-{uuid.uuid4().hex}"
    sources.write_feed(feed(spark, sf), folder)
    back = sources.read_feed(spark, folder, bad_rows="bad_row")
    return rounded(back.drop("chunk", *sources.POSSESSION))


def sequence_events_query(spark, sf):
    return rounded(sequenced(spark, sf).select(*SEQUENCED_COLUMNS))


def turnover_pseudo_events(spark, sf):
    return rounded(sequenced(spark, sf).filter("pseudoEvent").select(*SEQUENCED_COLUMNS))


def completed_passes(spark, sf):
    return sequenced(spark, sf).filter("adjPass = 1").select(
        *EVENT_KEY, "adjEventName", "playNumber", "sequenceNumber")


def incursions(spark, sf):
    return sequenced(spark, sf).filter(
        "attackIncursion = 1 OR penaltyIncursion = 1").select(
        *EVENT_KEY, "attackIncursion", "penaltyIncursion")


def pass_flags(spark, sf):
    return rounded(mark_passes(sequenced(spark, sf)).select(
        *EVENT_KEY, "direction", "duration", "isBackPass", "isFwdPass", "isSidePass",
        "isPass10m", "isPass10_20m", "isPass20m"))


def zones(spark, sf):
    return mark_passes(sequenced(spark, sf)).select(*EVENT_KEY, "zone")


def goal_fix(spark, sf):
    return rounded(mark_passes(sequenced(spark, sf))
                   .filter("adjEventName = 'goal'")
                   .select(*EVENT_KEY, "lengthMetres", "lengthFraction", "zone"))


def enriched_events(spark, sf):
    return rounded(enriched(spark, sf).select(*ENRICHED_COLUMNS))


# --- roll-ups ---------------------------------------------------------------
def plays_query(spark, sf):
    return rounded(plays(spark, sf))


def match_team_profile(spark, sf):
    return rounded(profile.match_team_profile(plays(spark, sf)))


def team_profile(spark, sf):
    return rounded(profile.team_profile(plays(spark, sf)))


def age_totals(spark, sf):
    return rounded(profile.age_totals(plays(spark, sf)))


def game_totals(spark, sf):
    return rounded(profile.game_totals(plays(spark, sf)))


def match_features(spark, sf):
    shares = [f"{c}_pcnt" for c in (*MATCH_SUMS, *MATCH_DERIVED)]
    return rounded(profile.match_features(plays(spark, sf)).select(*FEATURE_KEYS, *shares))


def match_labels(spark, sf):
    return profile.match_features(plays(spark, sf)).select(
        *FEATURE_KEYS, "result", "default")


# --- incremental conversion ---------------------------------------------------
def _history(df: DataFrame) -> DataFrame:
    """Stands for the games converted earlier: the top-flight ones."""
    return sources.competition_extract(df, TOP_FLIGHT)


def new_games(spark, sf):
    events = feed(spark, sf)
    return sources.unconverted_games(events, _history(events))


def pending_events(spark, sf):
    events = feed(spark, sf)
    return sources.pending_events(events, _history(events)).select(
        "gameID", "ord", "competition", "eventName")


def converted_append(spark, sf):
    events = feed(spark, sf)
    history = sequence_events(_history(events))
    added = sequence_events(sources.pending_events(events, _history(events)))
    return sources.converted_append(history, added).groupBy("gameID", "competition").agg(
        F.count(F.lit(1)).alias("n_events"), F.max("playNumber").alias("n_plays"))


def converted_batches(spark, sf):
    """Two deliveries, the second with the games of the first again."""
    events = stage(feed(spark, sf))
    folder = f"{workspace(spark)}/converted-{uuid.uuid4().hex}"
    conversion.convert(_history(events), folder)
    tables = conversion.convert(events, folder)
    counts = tables.read("sequenced").groupBy("gameID", "competition").agg(
        F.count(F.lit(1)).alias("n_events"))
    played = tables.read("plays").groupBy("gameID").agg(F.count(F.lit(1)).alias("n_plays"))
    return counts.join(played, "gameID", "left").withColumn(
        "n_plays", F.coalesce("n_plays", F.lit(0)))


def competition_extract(spark, sf):
    return rounded(sources.competition_extract(plays(spark, sf), TOP_FLIGHT))


# --- reports ------------------------------------------------------------------
def passing_breakdown(spark, sf):
    return rounded(reports.passing_breakdown(plays(spark, sf)))


def passing_breakdown_fouls(spark, sf):
    return rounded(reports.passing_breakdown(plays(spark, sf), "foul", False))


def heat_map_us(spark, sf):
    return rounded(reports.heat_map(enriched(spark, sf), "true"))


def heat_map_opposition(spark, sf):
    return rounded(reports.heat_map(enriched(spark, sf), "false"))


def heat_map_first_contacts(spark, sf):
    return rounded(reports.heat_map(
        enriched(spark, sf), "true", include_no_pass=False,
        outcome="AttackIncursion", just_first=True))


def _positions(spark, sf):
    """The event columns a play map reads, staged because it reads them twice."""
    return stage(enriched(spark, sf).select(
        "matchName", "gameID", "playNumber", "sequenceNumber", "maxSequenceNumber",
        "pseudoEvent", "ord", "epochTime", "playByUs", "firstEvent", "isGoal",
        "isAttackIncursion", "lengthMetres", "widthMetres", "lengthFraction",
        "widthFraction"))


def play_map_segments(spark, sf):
    return rounded(reports.play_map(_positions(spark, sf)))


def play_map_attacks(spark, sf):
    return rounded(reports.play_map(
        _positions(spark, sf), outcome="AttackIncursion", start_pct=25, end_pct=75))


def heat_map_goals(spark, sf):
    """Our plays against one opponent that end in a goal."""
    return rounded(reports.heat_map(
        enriched(spark, sf), "true", outcome="goal", opponent="Opp_3"))


def game_possession_match(spark, sf):
    """The first match's series."""
    events = stage(enriched(spark, sf))
    first = events.agg(F.min("matchName")).first()[0]
    return rounded(reports.game_possession(events, "all", first))


def unlabelled_documents(spark, sf):
    return sources.unseen(spark.read.parquet(f"{sf}/documents.parquet"),
                          spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")


def scoreboard(spark, sf):
    return reports.scoreboard(enriched(spark, sf))


def team_stats_count(spark, sf):
    games = stage(profile.game_totals(plays(spark, sf)))
    return rounded(reports.team_stats(games, list(STATS)))


def team_stats_share(spark, sf):
    games = stage(profile.game_totals(plays(spark, sf)))
    return rounded(reports.team_stats(games, SHARE_STATS, as_share=True))


def match_result(spark, sf):
    games = profile.game_totals(plays(spark, sf))
    return reports.match_results(games).orderBy("gameDate", "matchName")


def age_stats_count(spark, sf):
    return rounded(reports.age_stats(profile.age_totals(plays(spark, sf)), list(STATS)))


def age_stats_share(spark, sf):
    ages = stage(profile.age_totals(plays(spark, sf)))
    return rounded(reports.age_stats(ages, SHARE_STATS, as_share=True))


def _possession(kind: str) -> Query:
    def query(spark, sf):
        return rounded(reports.game_possession(enriched(spark, sf), kind))
    return query


def _pick_list(column: str) -> Query:
    def query(spark, sf):
        return reports.pick_list(enriched(spark, sf), column)
    return query


def team_priority(spark, sf):
    return reports.team_priority(plays(spark, sf)).select(
        "gameID", "competition", "teamName", "playNumber", "orderCol")


# --- team clusters ------------------------------------------------------------
def scaled_profiles(spark, sf):
    return rounded(cluster.scaled_long(teams(spark, sf)), 5)


def cosine_distances(spark, sf):
    scaled = stage(cluster.scaled_long(teams(spark, sf)))
    return rounded(cluster.cosine_from(scaled, f"{GIRLS_16}|Us_1|true"), 5)


def pca_variables_top20(spark, sf):
    return rounded(cluster.variable_coordinates(cluster.scaled_vectors(teams(spark, sf))))


def listed_teams(spark, sf):
    """All the wanted teams, and the scaled vectors of those with a complete profile."""
    profiles = stage(profile.team_profile(plays(spark, sf)))
    scaled = cluster.scaled_vectors(stage(cluster.dashboard_teams(profiles)))
    return cluster.dashboard_ids(profiles), scaled


def pca_individuals(spark, sf):
    ids, scaled = listed_teams(spark, sf)
    return rounded(cluster.individual_coordinates(scaled, ids))


def kmeans_teams(spark, sf):
    """Every team; those without a complete profile have no cluster, and a reason."""
    ids, scaled = listed_teams(spark, sf)
    return cluster.with_reason(ids, cluster.kmeans_teams(scaled))


def ward_teams(spark, sf):
    """Every team; those outside the tree have no cluster, and a reason."""
    ids, scaled = listed_teams(spark, sf)
    return cluster.with_reason(ids, cluster.ward_teams(scaled))


def ward_steps(spark, sf):
    """The merges, then the teams outside the tree, with a reason."""
    ids, scaled = listed_teams(spark, sf)
    steps = cluster.ward_steps(scaled).withColumn("reason", F.lit(None).cast("string"))
    return rounded(steps.unionByName(cluster.ward_unmerged(scaled, ids)))


def nearest_teams(spark, sf):
    """The five nearest teams of each team, by cosine distance."""
    found = nearest(cluster.unit_rows(cluster.scaled_vectors(teams(spark, sf))))
    return rounded(found, 5)


def pca_spectrum(spark, sf):
    return rounded(cluster.spectrum(cluster.scaled_vectors(teams(spark, sf))), 4)


def cluster_input(spark, sf):
    """Complete team profiles under their display names."""
    chosen = cluster.chosen_teams(profile.team_profile(plays(spark, sf)))
    return cluster.display_names(rounded(chosen))


# --- the same operators on the other tables -----------------------------------
def line_distribution(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return rounded(reports.distribution(lines, "l_linenumber", "l_returnflag"))


def customers_without_orders(spark, sf):
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return sources.unseen(customers.withColumnRenamed("c_custkey", "custkey"),
                          orders.withColumnRenamed("o_custkey", "custkey"), "custkey")


def embedding_components(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        "vec_id", "label", array_to_vector("embedding").alias("raw"))
    return rounded(cluster.on_components(cluster.standardised(rows)).select(
        "vec_id", "label", "pca_1", "pca_2"))


# --- classifiers --------------------------------------------------------------
def label_correlation(spark, sf):
    return rounded(classify.label_correlation(labelled(spark, sf)))


def stratified_split(spark, sf):
    return classify.stratified_split(labelled(spark, sf)).select(
        *classify.ROW_ID, "default", "in_train")


def cv_folds(spark, sf):
    return models.cv_folds(labelled(spark, sf))


def cv_predictions(spark, sf):
    return rounded(models.cv_predictions(labelled(spark, sf), MODELS))


def model_predictions(spark, sf):
    return rounded(models.all_predictions(labelled(spark, sf), MODELS))


def model_confusion(spark, sf):
    return models.confusion(models.all_predictions(labelled(spark, sf), MODELS))


def model_label_totals(spark, sf):
    return models.label_totals(models.all_predictions(labelled(spark, sf), MODELS))


def model_importance(spark, sf):
    return rounded(models.importance(labelled(spark, sf), MODELS))


QUERIES: dict[str, Query] = {
    "feed_events": feed_events,
    "feed_roundtrip": feed_roundtrip,
    "sequence_events": sequence_events_query,
    "turnover_pseudo_events": turnover_pseudo_events,
    "completed_passes": completed_passes,
    "incursions": incursions,
    "pass_flags": pass_flags,
    "zones": zones,
    "goal_fix": goal_fix,
    "enriched_events": enriched_events,
    "plays": plays_query,
    "match_team_profile": match_team_profile,
    "team_profile": team_profile,
    "age_totals": age_totals,
    "game_totals": game_totals,
    "match_features": match_features,
    "match_labels": match_labels,
    "new_games": new_games,
    "pending_events": pending_events,
    "converted_append": converted_append,
    "converted_batches": converted_batches,
    "competition_extract": competition_extract,
    "passing_breakdown": passing_breakdown,
    "passing_breakdown_fouls": passing_breakdown_fouls,
    "heat_map_us": heat_map_us,
    "heat_map_opposition": heat_map_opposition,
    "heat_map_first_contacts": heat_map_first_contacts,
    "heat_map_goals": heat_map_goals,
    "play_map_segments": play_map_segments,
    "play_map_attacks": play_map_attacks,
    "scoreboard": scoreboard,
    "team_stats_count": team_stats_count,
    "team_stats_share": team_stats_share,
    "match_result": match_result,
    "age_stats_count": age_stats_count,
    "age_stats_share": age_stats_share,
    "game_possession": _possession("all"),
    "game_possession_attacking": _possession("attPossession"),
    "game_possession_defensive": _possession("defPossession"),
    "game_possession_match": game_possession_match,
    "pick_list_opponents": _pick_list("theirName"),
    "pick_list_matches": _pick_list("matchName"),
    "team_priority": team_priority,
    "scaled_profiles": scaled_profiles,
    "cosine_distances": cosine_distances,
    "label_correlation": label_correlation,
    "stratified_split": stratified_split,
    "cluster_input": cluster_input,
    "line_distribution": line_distribution,
    "customers_without_orders": customers_without_orders,
    "unlabelled_documents": unlabelled_documents,
    "embedding_components": embedding_components,
    "pca_variables_top20": pca_variables_top20,
    "pca_individuals": pca_individuals,
    "kmeans_teams": kmeans_teams,
    "ward_teams": ward_teams,
    "ward_steps": ward_steps,
    "nearest_teams": nearest_teams,
    "pca_spectrum": pca_spectrum,
    "cv_folds": cv_folds,
    "cv_predictions": cv_predictions,
    "model_predictions": model_predictions,
    "model_confusion": model_confusion,
    "model_label_totals": model_label_totals,
    "model_importance": model_importance,
}
