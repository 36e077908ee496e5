"""Constraint bindings for three kinds of data: race results, sales orders, and credit risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions.nulls import holds
from attestra.operators import constraints as K
from attestra.operators import features as X

# Race results -----------------------------------------------------------------

#: From a season on, the last finishing position that scores points.
SCORING_CUTOFFS = ((1950, 5), (1960, 6), (2003, 8), (2010, 10))
POSITION_RANGE = (1, 39)


def racing_tables(tables: K.Tables, cutoffs: Sequence[tuple[int, int]] = SCORING_CUTOFFS) -> dict[str, DataFrame]:
    """The tables with three derived ones: the last standings of each season, results with their year, and with the scoring cut-off."""
    races = tables["races"].select("raceId", "year", "round")
    standings = X.lookup(tables["standings"].select("raceId", "driverId", "points"), races, "raceId")
    final = X.latest_rows(standings, ["driverId", "year"], ["round", "raceId"])
    results = X.lookup(tables["results"], races, "raceId", columns=["year"])
    with_cutoff = results.withColumn("cutoff", X.step_function(F.col("year"), cutoffs, "scoring cut-off"))
    return dict(tables) | {"season_final_standings": final, "results_with_year": results, "results_with_cutoff": with_cutoff}


def racing_constraints() -> list[K.Constraint]:
    fk = [K.ReferentialIntegrity(f"results_fk_{t}", "results", f"{t}Id", t + "s", f"{t}Id") for t in ("race", "driver", "constructor")]
    return [
        *fk,
        K.Cardinality("results_unique_per_race_driver", "results", ["raceId", "driverId"], exact=1),
        K.Cardinality("standings_unique_per_race_driver", "standings", ["raceId", "driverId"], exact=1),
        K.AggregateConsistency("season_points_consistency", "season_final_standings", ["driverId", "year"], "points", "results_with_year", ["driverId", "year"], "points"),
        K.TemporalOrder("qualifying_before_race", "qualifying", "date", "races", "date", "raceId", "<="),
        K.DenialConstraint("points_non_negative", "results", "points < 0"),
        K.DenialConstraint("fia_scoring_position_eligibility", "results_with_cutoff", "points > 1 AND positionOrder > cutoff"),
    ]


def top3_bounds(qualifying: DataFrame, dates: DataFrame, days: int = 30) -> DataFrame:
    """(date, exact, min, max): drivers in the first three, from the sessions in the days after a date."""
    sessions = qualifying.select("raceId", F.col("date").alias("at"))
    n = X.windows_ahead(dates, "date", sessions, "at", days, F.countDistinct("raceId").alias("n"))
    return n.select("date", F.expr("CASE n WHEN 0 THEN 0 WHEN 1 THEN 3 END").alias("exact"), F.expr("CASE WHEN n > 1 THEN 3 END").alias("min"), F.expr("CASE WHEN n > 1 THEN 3 * n END").alias("max"))


def position_bounds(results: DataFrame, dates: DataFrame, days: int) -> DataFrame:
    """(date, max_position): the largest finishing position in the days after a date, null without races."""
    return X.windows_ahead(dates, "date", results.select("positionOrder", F.col("date").alias("at")), "at", days, F.max("positionOrder").alias("max_position"))


def top3_per_window() -> K.Constraint:
    return K.Cardinality("top3_predictions_per_window", "predictions", "date", row_filter="top3_pred = 1", universe_table="windows", bounds_table="bounds")


def position_in_domain() -> K.Constraint:
    inside = lambda df: F.col("position_pred").between(F.lit(POSITION_RANGE[0]), F.col("max_position"))
    return K.DenialConstraint("position_pred_in_domain", "predictions", lambda df: ~holds(inside(df)))


def positions_without_duplicates(name: str = "qualifying_position_no_duplicates_per_race") -> K.Constraint:
    return K.Cardinality(name, "predictions", ["raceId", "position_pred"], max=1)


def with_race_id(predictions: DataFrame, sessions: DataFrame, entity_col: str) -> DataFrame:
    """predictions with the race of their entity's session on that date, null where there is none."""
    return X.lookup(predictions, sessions.select(entity_col, "date", "raceId"), [entity_col, "date"])


def rounded(df: DataFrame, col: str) -> DataFrame:
    """Predictions as whole numbers, halves to even."""
    return df.withColumn(col, F.bround(col, 0))


def qualifying_features(instances: DataFrame, qualifying: DataFrame, results: DataFrame) -> DataFrame:
    """Means of the last five positions strictly before each instance: the driver's and constructor's qualifying, the driver's results."""
    out = X.lag_mean(instances, qualifying, "driverId", "date", "position", tiebreak="raceId", out="driver_quali_avg_last5")
    out = X.lag_mean(out, qualifying, "constructorId", "date", "position", tiebreak=["raceId", "driverId"], out="constructor_quali_avg_last5")
    return X.lag_mean(out, results, "driverId", "date", "positionOrder", tiebreak="raceId", out="driver_result_avg_last5")


# Sales orders ------------------------------------------------------------------

INCOTERMS = range(14)
CONSISTENT_TARGETS = ("PLANT", "SHIPPINGPOINT", "ITEMINCOTERMSCLASSIFICATION")


def _outside(col: str):
    return lambda df: ~holds(F.col(col).isin(*INCOTERMS))


def sales_constraints() -> list[K.Constraint]:
    pair = lambda c: K.PairDisagreement(f"items_share_{c.lower()}_within_order", "salesdocumentitem", "SALESDOCUMENT", "ID", c)
    fd = K.FunctionalDependency
    return [
        K.ReferentialIntegrity("item_fk_salesdocument", "salesdocumentitem", "SALESDOCUMENT", "salesdocument", "SALESDOCUMENT"),
        K.ReferentialIntegrity("item_fk_soldtoparty", "salesdocumentitem", "SOLDTOPARTY", "customer", "CUSTOMER"),
        K.ReferentialIntegrity("customer_fk_address", "customer", "ADDRESSID", "address", "ADDRESSID"),
        K.Cardinality("order_has_at_least_one_item", "salesdocumentitem", "SALESDOCUMENT", min=1, universe_table="salesdocument"),
        *map(pair, CONSISTENT_TARGETS),
        fd("salesorg_determines_division", "salesdocument", "SALESORGANIZATION", "ORGANIZATIONDIVISION"),
        fd("salesorg_determines_billing_company_code", "salesdocument", "SALESORGANIZATION", "BILLINGCOMPANYCODE"),
        fd("shippingpoint_determines_plant", "salesdocumentitem", "SHIPPINGPOINT", "PLANT"),
        fd("salesgroup_determines_salesoffice", "salesdocument", "SALESGROUP", "SALESOFFICE"),
        K.DenialConstraint(
            "item_incoterms_matches_header_incoterms", "salesdocumentitem", "NOT coalesce(ITEMINCOTERMSCLASSIFICATION = HEADERINCOTERMSCLASSIFICATION, false)",
            right="salesdocument", join_on="SALESDOCUMENT", columns=["ITEMINCOTERMSCLASSIFICATION", "HEADERINCOTERMSCLASSIFICATION"],
        ),
        K.DenialConstraint("item_incoterms_in_fixed_vocabulary", "salesdocumentitem", _outside("ITEMINCOTERMSCLASSIFICATION")),
        K.DenialConstraint("header_incoterms_in_fixed_vocabulary", "salesdocument", _outside("HEADERINCOTERMSCLASSIFICATION")),
    ]


def consistency_constraint(target: str) -> K.Constraint:
    if target not in CONSISTENT_TARGETS:
        raise ValueError(f"{target} is none of {', '.join(CONSISTENT_TARGETS)}")
    return K.PairDisagreement(f"{target.lower()}_consistent_within_order", "predictions", "SALESDOCUMENT", "ID", f"{target}_pred")


def cross_task_fd(name: str, determinant: str, dependent: str) -> K.Constraint:
    return K.FunctionalDependency(name, "combined", determinant, dependent)


def item_header_incoterms() -> K.Constraint:
    same = "coalesce(ITEMINCOTERMSCLASSIFICATION_pred = HEADERINCOTERMSCLASSIFICATION_pred, false)"
    return K.DenialConstraint("item_incoterms_pred_matches_header_incoterms_pred", "combined", f"NOT {same}")


def with_order(predictions: DataFrame, items: DataFrame) -> DataFrame:
    return X.lookup(predictions, items.select("ID", "SALESDOCUMENT"), "ID")


#: The columns that models see, besides those that a task removes.
ITEM_FEATURES = (
    "SALESDOCUMENTITEMCATEGORY", "PRODUCT", "SOLDTOPARTY", "SHIPTOPARTY", "BILLTOPARTY", "PAYERPARTY", "ITEMINCOTERMSCLASSIFICATION",
)
HEADER_FEATURES = (
    "SALESOFFICE", "SALESGROUP", "CUSTOMERPAYMENTTERMS", "SHIPPINGCONDITION", "SALESDOCUMENTTYPE", "SALESORGANIZATION", "DISTRIBUTIONCHANNEL",
    "ORGANIZATIONDIVISION", "BILLINGCOMPANYCODE", "TRANSACTIONCURRENCY", "HEADERINCOTERMSCLASSIFICATION",
)
ADDRESS_FEATURES = ("COUNTRY", "REGION")
#: (table, column) pairs that a task must not show its model.
Removed = Sequence[tuple[str, str]]


def _shown(table: str, columns: Sequence[str], removed: Removed) -> list[str]:
    return [c for c in columns if (table, c) not in set(removed)]


def item_features(instances: DataFrame, tables: K.Tables, removed: Removed = ()) -> DataFrame:
    """ID with its item's and header's columns, and the country and region of where it goes; an item that isn't there fails the job."""
    item, header = _shown("salesdocumentitem", ITEM_FEATURES, removed), _shown("salesdocument", HEADER_FEATURES, removed)
    needed = list(dict.fromkeys(["SALESDOCUMENT", "SHIPTOPARTY", *item]))
    out = X.lookup(instances.select("ID"), tables["salesdocumentitem"], "ID", columns=needed, required=True)
    out = X.lookup(out, tables["salesdocument"], "SALESDOCUMENT", columns=header)
    customers = X.lookup(tables["customer"].select("CUSTOMER", "ADDRESSID"), tables["address"], "ADDRESSID", columns=ADDRESS_FEATURES)
    out = X.lookup(out, customers, "SHIPTOPARTY", "CUSTOMER", ADDRESS_FEATURES)
    return out.select("ID", *item, *header, *ADDRESS_FEATURES)


def header_features(instances: DataFrame, tables: K.Tables, removed: Removed = ()) -> DataFrame:
    """SALESDOCUMENT with its header's columns."""
    header = _shown("salesdocument", HEADER_FEATURES, removed)
    return X.lookup(instances.select("SALESDOCUMENT"), tables["salesdocument"], "SALESDOCUMENT", columns=header, required=True)


def features_for(entity_col: str, instances: DataFrame, tables: K.Tables, removed: Removed = ()) -> DataFrame:
    builders = {"ID": item_features, "SALESDOCUMENT": header_features}
    if entity_col not in builders:
        raise ValueError(f"no features for {entity_col}")
    return builders[entity_col](instances, tables, removed)


# Credit risk ---------------------------------------------------------------------

#: Feature, move, lower and upper end of its range, direction of the predicted risk of a good outcome.
MONOTONE = {"ExternalRiskEstimate": (10, None, 94, "non_decreasing"), "NetFractionRevolvingBurden": (-20, 0, None, "non_decreasing")}


def monotone(feature: str) -> K.Constraint:
    return K.MonotonicityConstraint(f"{feature}_monotonic", "_row_id", MONOTONE[feature][3])


def counterfactual(df: DataFrame, feature: str) -> DataFrame:
    delta, low, high, _ = MONOTONE[feature]
    return X.perturb(df, feature, delta, low, high)


#: Names of conventions rather than definitions.
SECOND_TIER = frozenset(
    ["fia_scoring_position_eligibility", "item_incoterms_matches_header_incoterms", "item_incoterms_in_fixed_vocabulary", "header_incoterms_in_fixed_vocabulary", "item_incoterms_pred_matches_header_incoterms_pred"]
    + [f"items_share_{c.lower()}_within_order" for c in CONSISTENT_TARGETS]
    + [f"{c.lower()}_consistent_within_order" for c in CONSISTENT_TARGETS]
)
