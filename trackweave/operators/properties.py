"""The columns of the catalogue that follow from a track's bound members (IO14): types, motion, energies, shapes, extents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import geometry as g
from trackweave.operators import aggregates as ag
from trackweave.operators import profiles as pr

#: Names of the columns, as the catalogue has them.
COLUMNS = (
    "n_bound_type", "m_bound_type", "tracer_index", "comoving_average_position", "physical_average_velocity",
    "specific_self_potential_energy", "specific_self_kinetic_energy", "specific_angular_momentum", "inertial_tensor",
    "inertial_tensor_weighted", "bound_m200_crit", "bound_r200_crit_comoving",
)
_AXES = ("xx", "xy", "xz", "yy", "yz", "zz")


def centred(bound: DataFrame, by: Sequence[str]) -> DataFrame:
    """bound with first_id and position and velocity (cx .. cvz) of the most bound member of its track."""
    motion = (*ag.XYZ, *ag.VEL)
    c = bound.groupBy(*by).agg(F.min_by(F.struct("particle_id", *motion), F.struct("rank", "particle_id")).alias("_c"))
    return bound.join(c, list(by)).select("*", F.col("_c.particle_id").alias("first_id"), *[F.col(f"_c.{x}").alias(f"c{x}") for x in motion]).drop("_c")


def track_properties(bound: DataFrame, by: Sequence[str], tracer: Column, energy: str = "energy", thermal: bool = False) -> DataFrame:
    """(by, COLUMNS) of every track with bound members.

    bound: by, particle_id, rank, x .. vz, mass, u, type, hz, scale_factor, box_size, soft, density (the threshold of the
    extent, in masses per cubed radius) and the energy. Each part is one aggregate that merges before its shuffle.
    Tracks without mass have null means and energies; m200 and r200 are null where nothing is dense enough.
    """
    c = centred(bound, by)
    kinds = ag.type_counts(bound, by).join(ag.tracer_index(bound, by, tracer), list(by))
    kinds = kinds.select(
        *by,
        F.array(*[F.col(f"n_{k}") for k in range(ag.N_TYPES)]).alias("n_bound_type"),
        F.array(*[F.col(f"m_{k}") for k in range(ag.N_TYPES)]).alias("m_bound_type"),
        F.col("tracer_index").cast("long").alias("tracer_index"),
    )
    mean = ag.mean_motion(bound, by, "rank").select(
        *by, F.array(*ag.XYZ).alias("comoving_average_position"), F.array(*ag.VEL).alias("physical_average_velocity")
    )
    energies = ag.kinematics(c, by, g.vec("c"), g.vec("cv"), energy, thermal).select(
        *by,
        F.col("potential").alias("specific_self_potential_energy"),
        F.col("kinetic").alias("specific_self_kinetic_energy"),
        F.array("lx", "ly", "lz").alias("specific_angular_momentum"),
    )
    shape = ag.inertia(c, by, g.vec("c"), F.col("particle_id") == F.col("first_id")).select(
        *by,
        F.array(*[f"i{a}" for a in _AXES]).alias("inertial_tensor"),
        F.array(*[f"w_i{a}" for a in _AXES]).alias("inertial_tensor_weighted"),
    )
    radii = c.select(*by, "particle_id", "mass", g.distance(g.vec(""), g.vec("c"), "box_size").alias("r"), "soft", "density")
    extent = pr.summary(pr.cumulative(radii, by, "r"), by, "r", "soft", "density").select(
        *by, F.col("m_over").alias("bound_m200_crit"), F.col("r_over").alias("bound_r200_crit_comoving")
    )
    out = kinds
    for part in (mean, energies, shape, extent):
        out = out.join(part, list(by))
    return out.select(*by, *COLUMNS)
