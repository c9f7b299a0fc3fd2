"""Count scales and thermal energies."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Boltzmann's constant in the units a free energy can be given in,
# kT itself aside, and the constants of the barrier models.
BOLTZMANN = {
    "kJ/mol": 8.314462618e-3,
    "kcal/mol": 8.314462618e-3 / 4.184,
    "eV": 8.617333262e-5,
    "meV": 8.617333262e-2,
    "cm^-1": 0.6950348005,
}
BOLTZMANN_EV = 8.617333262145e-5
BOLTZMANN_J = 1.380649e-23
PLANCK_J_S = 6.62607015e-34

UNITS = ("kT", *BOLTZMANN)


def thermal_energy(unit: str, temperature: float | None = None) -> float:
    """kT in a unit; the unit kT needs no temperature."""
    if unit == "kT":
        return 1.0
    if unit not in BOLTZMANN:
        raise ValueError(f"unknown energy unit {unit!r}; one of {', '.join(UNITS)}")
    if temperature is None or not math.isfinite(temperature) or temperature <= 0:
        raise ValueError(f"unit {unit!r} needs a positive temperature; got {temperature}")
    return BOLTZMANN[unit] * temperature


def log_count(count: Column) -> Column:
    """log10(count + 1); null where nothing was counted."""
    return F.when(count > 0, F.log10(count + F.lit(1)))


def free_energy(count: Column, largest: Column, unit: str = "kT", temperature: float | None = None) -> Column:
    """kT ln(largest / count); null where nothing was counted."""
    return F.when(count > 0, F.lit(thermal_energy(unit, temperature)) * F.log(largest / count))


def barrier_prefactor(model: str, temperature: float, transmission: float = 1.0, attempt_frequency: float | None = None) -> float:
    """Rate at no barrier: Eyring's kappa kT/h, or the Arrhenius attempt frequency."""
    if not (temperature > 0):
        raise ValueError(f"temperature must be positive; got {temperature}")
    if model == "eyring":
        if not transmission > 0:
            raise ValueError(f"the transmission coefficient must be positive; got {transmission}")
        return transmission * BOLTZMANN_J * temperature / PLANCK_J_S
    if model == "arrhenius":
        if attempt_frequency is None or not attempt_frequency > 0:
            raise ValueError("the arrhenius model needs a positive attempt frequency")
        return attempt_frequency
    raise ValueError(f"unknown barrier model {model!r}; eyring or arrhenius")


def barrier(rate: Column, model: str, temperature: float, *, transmission: float = 1.0, attempt_frequency: float | None = None, conversion: float = 1.0) -> Column:
    """-kT ln(rate / prefactor) in eV times a conversion; null for a rate that is not positive and finite."""
    kt = BOLTZMANN_EV * temperature
    prefactor = barrier_prefactor(model, temperature, transmission, attempt_frequency)
    ok = rate.isNotNull() & ~F.isnan(rate) & (rate > 0) & (rate < float("inf"))
    return F.when(ok, F.lit(-kt) * F.log(rate / F.lit(prefactor)) * F.lit(conversion))
