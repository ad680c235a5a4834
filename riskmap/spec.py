"""Column roles.

Every operator is generic over a frozen :class:`RoleSpec`.  Two specs ship:

* ``HOUSEHOLD_SPEC`` -- the column roles of the household survey table the
  toolkit was designed around (38 documented columns).
* ``CUSTOMER_SPEC`` -- the same roles mapped onto the ``cust_features`` table
  that is derived from the driver's TPC-H-like tables (see
  ``riskmap.sources.fixtures``).  It is what the registered queries run on.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RoleSpec:
    outcome: str
    ids: tuple[str, ...]
    leak: tuple[str, ...] = ()
    low_quality: tuple[str, ...] = ()
    weight: tuple[str, ...] = ()
    sentinel_columns: tuple[str, ...] = ()
    sentinel_values: tuple[int, ...] = ()
    refusal_columns: tuple[str, ...] = ()
    refusal_code: str = "R"
    bool_columns: tuple[str, ...] = ()
    distance: tuple[str, ...] = ()
    # (name, numerator, denominator); eps is added to the denominator
    ratios: tuple[tuple[str, str, str], ...] = ()
    ratio_eps: float = 1e-3
    ordinal: tuple[str, ...] = ()
    passthrough: tuple[str, ...] = ()
    nominal: tuple[str, ...] = ()
    profile_only: tuple[str, ...] = ()
    # substrings that mark geography columns (segmentation without geography)
    geo_substrings: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    @property
    def log_columns(self) -> tuple[str, ...]:
        return tuple(f"{c}_log1p" for c in self.distance)

    @property
    def ratio_columns(self) -> tuple[str, ...]:
        return tuple(r[0] for r in self.ratios)

    @property
    def numeric_candidates(self) -> tuple[str, ...]:
        """Columns that are standardized: distances, their logs, ratios, ordinals."""
        return self.distance + self.log_columns + self.ratio_columns + self.ordinal

    @property
    def drop_columns(self) -> tuple[str, ...]:
        return self.leak + self.ids + self.low_quality + self.weight + (self.outcome,)

    @property
    def id(self) -> str:
        return self.ids[0]


# --- fixed values: household survey column roles -----------------------------
# These names and codes must equal the source survey file's for the toolkit to
# run on it unchanged.
HOUSEHOLD_SPEC = RoleSpec(
    outcome="food_insecure_flag_adult",
    ids=("hhnum",),
    leak=("adltfscat", "foodsufficient"),
    low_quality=("caraccess", "fah_storetype_unique"),
    weight=("hhwgt",),
    sentinel_columns=("foodpantry", "anyvehicle", "vehiclenum"),
    sentinel_values=(-996, -997, -998),
    refusal_columns=("head_hispanic", "head_racecat"),
    refusal_code="R",
    bool_columns=("snap_any",),
    distance=("dist_sm", "dist_cs", "dist_walmart", "nearsnap_dist",
              "nearff_dist", "nearnonff_dist"),
    ratios=(
        ("children_per_adult", "num_children", "num_adults"),
        ("elderly_share", "num_elderly", "household_size"),
        ("children_share", "num_children", "household_size"),
        ("employed_adult_share", "employed_adults", "num_adults"),
    ),
    ratio_eps=1e-3,
    ordinal=("head_educcat", "head_age"),
    passthrough=("snap_any", "foodpantry", "household_size", "num_adults",
                 "num_children", "num_elderly", "employed_adults",
                 "any_employed_adult", "rural", "nonmetro", "anyvehicle",
                 "vehiclenum", "fah_event_count", "fafh_event_count",
                 "fafh_schoolmeal_events"),
    nominal=("head_sex", "head_hispanic", "head_racecat", "head_employment",
             "region", "poverty_band", "targetgroup"),
    profile_only=("poverty_ratio",),
    geo_substrings=("dist_", "nearsnap", "nearff", "nearnonff", "rural",
                    "nonmetro", "region="),
)

# Profile feature lists used for the cluster and persona tables (fixed values).
HOUSEHOLD_CLUSTER_PROFILE = (
    "household_size", "num_adults", "num_children", "num_elderly",
    "employed_adults", "any_employed_adult", "head_age", "head_educcat",
    "poverty_ratio", "snap_any", "foodpantry", "rural", "nonmetro",
    "anyvehicle", "vehiclenum", "dist_sm", "dist_walmart", "nearsnap_dist",
    "fah_event_count", "fafh_event_count",
)
HOUSEHOLD_PERSONA_PROFILE = (
    "household_size", "num_adults", "num_children", "num_elderly",
    "employed_adults", "any_employed_adult", "head_age", "head_educcat",
    "poverty_ratio", "snap_any", "foodpantry", "fah_event_count",
    "fafh_event_count", "fafh_schoolmeal_events",
)
# --- end fixed values ---------------------------------------------------------


# The driver-table analogue: one row per customer (see sources.fixtures).
CUSTOMER_SPEC = RoleSpec(
    outcome="y",
    ids=("k",),
    leak=("ret_share",),
    low_quality=("near_const",),
    weight=("w",),
    sentinel_columns=("acctbal_s",),
    sentinel_values=(-996, -997, -998),
    refusal_columns=("segment_r",),
    refusal_code="R",
    bool_columns=("any_urgent",),
    distance=("dist_like",),
    ratios=(
        ("lines_per_order", "n_lines", "n_orders"),
        ("parts_per_line", "n_parts", "n_lines"),
        ("parts_per_order", "n_parts", "n_orders"),
        ("urgent_per_order", "any_urgent", "n_orders"),
    ),
    ratio_eps=1e-3,
    ordinal=("avg_disc", "avg_qty"),
    passthrough=("any_urgent", "acctbal_s", "n_orders", "n_lines", "n_parts"),
    nominal=("segment_r", "region", "nation", "balance_band"),
    profile_only=("profile_only",),
    geo_substrings=("dist_", "region=", "nation="),
)

CUSTOMER_PROFILE = ("n_orders", "n_lines", "n_parts", "avg_disc", "avg_qty",
                    "any_urgent", "acctbal_s", "dist_like", "profile_only")
