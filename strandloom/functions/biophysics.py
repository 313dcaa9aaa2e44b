"""Biophysical descriptors of canonical sequences, as Column expressions; null for any other text.

All but the moment, the isoelectric point and the instability index are linear in residue counts.  Sums over residues are
computed in Arrow batches (:mod:`strandloom.functions.batches`), everything else by expressions.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions import batches
from strandloom.functions.sequence import RESIDUES, canonical, residue_count, residue_fractions

# Published scales by residue.  Fixed values.
#: Average masses of residues (IUPAC).
MASS = dict(A=71.0788, C=103.1388, D=115.0886, E=129.1155, F=147.1766, G=57.0519, H=137.1411, I=113.1594, K=128.1741, L=113.1594, M=131.1926, N=114.1038, P=97.1167, Q=128.1307, R=156.1875, S=87.0782, T=101.1051, V=99.1326, W=186.2132, Y=163.1760)
WATER = 18.0153
#: Consensus hydrophobicity (Eisenberg et al. 1984).
CONSENSUS = dict(A=0.62, C=0.29, D=-0.90, E=-0.74, F=1.19, G=0.48, H=-0.40, I=1.38, K=-1.50, L=1.06, M=0.64, N=-0.78, P=0.12, Q=-0.85, R=-2.53, S=-0.18, T=-0.05, V=1.08, W=0.81, Y=0.26)
#: Hydropathy (Kyte and Doolittle 1982).
HYDROPATHY = dict(A=1.8, C=2.5, D=-3.5, E=-3.5, F=2.8, G=-0.4, H=-3.2, I=4.5, K=-3.9, L=3.8, M=1.9, N=-3.5, P=-1.6, Q=-3.5, R=-4.5, S=-0.8, T=-0.7, V=4.2, W=-0.9, Y=-1.3)
#: Transfer free energy from cyclohexane to water (Radzicka and Wolfenden 1988).
TRANSFER = dict(A=-1.81, C=-1.28, D=8.72, E=6.81, F=-2.98, G=-0.94, H=4.66, I=-4.92, K=5.55, L=-4.92, M=-2.35, N=6.64, P=0.0, Q=5.54, R=9.38, S=3.40, T=2.57, V=-4.04, W=-2.33, Y=-0.14)
#: Acid constants: the chain's ends, and side chains by sign.
N_TERM, C_TERM = 9.69, 2.34
POSITIVE, NEGATIVE = dict(K=10.5, R=12.4, H=6.0), dict(D=3.86, E=4.25, C=8.33, Y=10.07)
PH, WINDOW = 7.4, 11


def _valid(s: Column, value: Column) -> Column:
    return F.when(canonical(s), value)


def molecular_weight(s: Column) -> Column:
    return _valid(s, F.round(batches.linear(s, MASS) + WATER, 4))


def net_charge(s: Column, ph: float = PH) -> Column:
    """Henderson-Hasselbalch charge, at pH 7.4 unless told otherwise."""
    up, down = lambda p: 1 / (1 + 10.0 ** (ph - p)), lambda p: 1 / (1 + 10.0 ** (p - ph))
    plus = up(N_TERM) + batches.linear(s, {r: up(p) for r, p in POSITIVE.items()})
    minus = down(C_TERM) + batches.linear(s, {r: down(p) for r, p in NEGATIVE.items()})
    return _valid(s, F.round(plus - minus, 4))


def isoelectric_point(s: Column, steps: int = 50) -> Column:
    """Where the charge, rounded to four digits, falls to zero, by bisection of 0 to 14: one power a step."""
    return _valid(s, F.round(batches.root(s, (N_TERM, C_TERM), POSITIVE, NEGATIVE, 0.0, 14.0, 0.00005, steps), 4))


def hydrophobic_moment(s: Column, window: int = WINDOW) -> Column:
    """The largest moment of a window, with 100 degrees a residue; a shorter sequence is one window."""
    return _valid(s, F.round(batches.moment(s, CONSENSUS, 100.0, window), 6))


def boman_index(s: Column) -> Column:
    return _valid(s, F.round(batches.linear(s, TRANSFER) / F.length(s), 2))


def gravy(s: Column) -> Column:
    """Mean hydropathy."""
    return _valid(s, F.round(batches.linear(s, HYDROPATHY) / F.length(s), 6))


def instability_index(s: Column, weights: Mapping[str, float], default: float = 1.0) -> Column:
    """Ten times the mean weight of adjacent residue pairs, over the length.

    ``weights`` is the pair table as a parameter, for instance read from a file; pairs that it lacks weigh ``default``.
    """
    table = [float(weights.get(a + b, default)) for a in RESIDUES for b in RESIDUES]
    return _valid(s, F.round(10 * batches.pairs(s, table) / F.length(s), 6))


def descriptors(s: Column, weights: Mapping[str, float] | None = None) -> Column:
    """The seven descriptors as a struct; the instability index is null without its table."""
    return F.struct(
        net_charge(s).alias("net_charge_ph7"), isoelectric_point(s).alias("isoelectric_point"), molecular_weight(s).alias("molecular_weight_da"),
        hydrophobic_moment(s).alias("eisenberg_hydrophobic_moment"), boman_index(s).alias("boman_index"), gravy(s).alias("grand_avg_hydropathy"),
        (F.lit(None).cast("double") if weights is None else instability_index(s, weights)).alias("instability_index"),
    )


def feature_vector(s: Column, weights: Mapping[str, float] | None = None) -> Column:
    """Twenty residue fractions, length and six descriptors as floats; descriptors of short sequences take defaults."""
    long = F.length(s) >= 8
    either = lambda value, default: F.coalesce(F.when(long, value), F.lit(float(default)))
    scalars = [
        F.greatest(F.length(s), F.lit(1)).cast("double"), either(net_charge(s), 0), either(isoelectric_point(s), 7), either(hydrophobic_moment(s), 0), either(gravy(s), 0), either(boman_index(s), 0),
        either(F.lit(None).cast("double") if weights is None else instability_index(s, weights), 30),
    ]
    return F.concat(residue_fractions(s), F.array(*scalars)).cast("array<float>")


def synthesis_reason(s: Column) -> Column:
    """The first obstacle to synthesis, ``warn_unpaired_cys``, or ``ok``.  Text is upper-cased and trimmed first."""
    s = F.upper(F.trim(F.coalesce(s, F.lit(""))))
    charge = net_charge(s)
    return (
        F.when(~canonical(s), "invalid_residue").when(~F.length(s).between(8, 50), "length_out_of_range").when(s.rlike("[VILFWM]{5,}"), "hydrophobic_run").when(s.rlike(r"(.)\1{3,}"), "polyrepeat")
        .when((hydrophobic_moment(s) > 0.6) & (charge < 1), "aggregation_risk").when(charge < 1, "insufficient_charge").when(residue_count(s, "C") == 1, "warn_unpaired_cys").otherwise("ok")
    )


def synthesizable(reason: Column) -> Column:
    return reason.isin("ok", "warn_unpaired_cys")


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def disruption_proxy(gravy_: Column, moment: Column) -> Column:
    return clip(0.5 * (gravy_ - 0.2) * 1.5 + 0.5 * (moment - 0.4) * 2.0, 0, 1)


def toxicity_risk(hemolysis: Column, proxy: Column) -> Column:
    return F.round(0.5 * hemolysis + 0.5 * proxy, 4)


def fitness(charge: Column, moment: Column, boman: Column, gravy_: Column, can_synthesize: Column) -> Column:
    """Search fitness: activity and toxicity scores and their composite, rounded to four digits."""
    by_charge = F.when(charge < 1, F.greatest(F.lit(0.0), charge) * 0.2).when(charge <= 6, 0.2 + 0.16 * (charge - 1)).otherwise(F.greatest(F.lit(0.5), 1 - (charge - 6) * 0.1))
    logistic = lambda x: 1 / (1 + F.exp(-x))
    by_gravy = F.when(gravy_ > 0.3, (gravy_ - 0.3) * 1.5).otherwise(F.greatest(F.lit(0.0), (-0.8 - gravy_) * 0.8))
    tox = clip(F.greatest(F.lit(0.0), moment - 0.65) + F.greatest(F.lit(0.0), gravy_ - 0.2), 0, 1)
    amp = clip(0.45 * by_charge + 0.45 * logistic(10 * (moment - 0.45)) - 0.1 * logistic(3 * (boman - 2.5)) - 0.1 * by_gravy, 0, 1)
    total = amp - 0.35 * tox - F.when(can_synthesize, 0.0).otherwise(0.25)
    return F.struct(F.round(total, 4).alias("composite_fitness"), F.round(amp, 4).alias("amp_score"), F.round(tox, 4).alias("toxicity_risk"))


def bounded_quality(amp: Column, tox: Column, sigma: Column, mic: Column, domains: Column, can_synthesize: Column) -> Column:
    """Lower-bound quality: probability less risk and spread, with bonuses for potency and agreement.  Fails on inputs out of range."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = finite(amp) & finite(tox) & finite(sigma) & amp.between(0, 1) & tox.between(0, 1) & (sigma >= 0) & can_synthesize.isNotNull()
    potency = F.when(mic.isNotNull() & ~F.isnan(mic) & (mic <= 32), 0.2 * (1 - mic / 32)).otherwise(0.0)
    value = amp - 0.5 * tox - sigma + potency + F.when(F.coalesce(domains, F.lit(1)) > 1, 0.05).otherwise(0.0) - F.when(can_synthesize, 0.0).otherwise(0.2)
    return F.when(good, F.round(value, 4)).otherwise(F.raise_error(F.lit("quality inputs must be present, finite and in range")).cast("double"))


def library_score(amp: Column, tox: Column, sigma: Column) -> Column:
    return amp - 0.5 * tox - sigma


#: Half-open bins of the niche grid: the lower edges of all bins but the first.
CHARGE_EDGES, MOMENT_EDGES, LENGTH_EDGES = (1.0, 3.0, 5.0, 7.0, 10.0), (0.30, 0.45, 0.60, 0.75), (15, 23, 31, 41)


def bin_of(x: Column, edges: tuple) -> Column:
    """How many of ``edges`` are at most ``x``."""
    return sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0))


def niche(charge: Column, moment: Column, length: Column) -> Column:
    return F.struct(bin_of(charge, CHARGE_EDGES).alias("c"), bin_of(moment, MOMENT_EDGES).alias("m"), bin_of(length, LENGTH_EDGES).alias("l"))


def finite_in(x: Column, lo: float = -math.inf, hi: float = math.inf) -> Column:
    """``x``, or an error if it is null, not a number, infinite or out of range."""
    good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf) & (x >= lo) & (x <= hi)
    return F.when(good, x).otherwise(F.raise_error(F.lit("a value is missing, not finite or out of range")).cast("double"))
