"""Every constant of the engine, as a field. Nothing reads a module-level switch."""

from __future__ import annotations

from dataclasses import dataclass, field

# Monoisotopic masses in Da.
PROTON = 1.007276
ELECTRON = 0.000549
WATER = 18.010565
AMMONIUM = 18.033823
SODIUM = 22.989770 - ELECTRON
POTASSIUM = 38.963707 - ELECTRON
FORMIC_ACID = 46.005480
CHLORIDE = 34.968853 + ELECTRON
ACETIC_ACID = 60.021130
METHYL = 15.023475

# Adduct, molecules in it, charge, and shift, where precursor * charge = mass * molecules + shift.
ADDUCTS = (
    ("[M+H]+", 1, 1, PROTON),
    ("[M+NH4]+", 1, 1, AMMONIUM - ELECTRON),
    ("[M-H2O+H]+", 1, 1, PROTON - WATER),
    ("[M-2H2O+H]+", 1, 1, PROTON - 2 * WATER),
    ("[M+Na]+", 1, 1, SODIUM),
    ("[M+K]+", 1, 1, POTASSIUM),
    ("[M-H]-", 1, 1, -PROTON),
    ("[M-H2O-H]-", 1, 1, -PROTON - WATER),
    ("[M+CH2O2-H]-", 1, 1, FORMIC_ACID - PROTON),
    ("[M+Cl]-", 1, 1, -CHLORIDE),
    ("[M]+", 1, 1, -ELECTRON),
    ("[M]-", 1, 1, ELECTRON),
    ("[M-H2O]+", 1, 1, -WATER - ELECTRON),
    ("[M+2H]2+", 1, 2, 2 * PROTON),
    ("[M-2H]2-", 1, 2, -2 * PROTON),
    ("[M-2H]-", 1, 1, -2 * PROTON),
    ("[2M+H]+", 2, 1, PROTON),
    ("[2M+Na]+", 2, 1, SODIUM),
    ("[2M-H]-", 2, 1, -PROTON),
    ("[2M+NH4]+", 2, 1, AMMONIUM - ELECTRON),
    ("[2M+CH2O2-H]-", 2, 1, FORMIC_ACID - PROTON),
    ("[2M+K]+", 2, 1, POTASSIUM),
    ("[M+C2H4O2-H]-", 1, 1, ACETIC_ACID - PROTON),
    ("[M-CH3]-", 1, 1, -METHYL - ELECTRON),
)

# Shifts that follow from the definition above where the table's differ: a gained chloride adds its mass, an
# ammonium ion has lost its electron already, and lost protons and methyl leave electrons behind.
CORRECTED = {
    "[M+Cl]-": CHLORIDE,
    "[M+NH4]+": AMMONIUM,
    "[2M+NH4]+": AMMONIUM,
    "[M-CH3]-": -METHYL + ELECTRON,
    "[M-2H]-": -2 * PROTON - ELECTRON,
}


@dataclass(frozen=True)
class EngineConfig:
    """Defaults are those of the workload's best published configuration."""

    peaks_kept: int = 40
    bin_width: float = 0.5
    max_mz: float = 2100.0
    coarse_top: int = 300
    fine_top: int = 50
    guesses: int = 25
    ppm: float = 30.0
    ppm_bonus: float = 0.05
    match_tol: float = 0.02
    merge_tol: float = 0.02
    widths: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0)
    exponent: float = 2.5
    alpha: float = 0.3
    model_floor: float = 0.05
    tier2_alpha: float = 0.0
    tier1_cap: int = 25
    prob_eps: float = 1e-4
    feature_bin: float = 0.2
    feature_max_mz: float = 1200.0
    tensor_peaks: int = 64
    pool_mass: tuple[float, float] = (120.0, 1300.0)
    # Elements of a structure that a pool takes.
    elements: tuple[str, ...] = ("C", "H", "N", "O", "P", "S", "F", "Cl", "Br", "I", "Se", "B", "Si")
    decoys: int = 32
    max_window: int = 20_000
    block_weight: float = 0.2
    #: True: the table of adducts as published; False: with the shifts that its definition gives.
    compat_adducts: bool = False
    # Bit ranges of the fingerprint families.
    blocks_v1: dict = field(default_factory=lambda: {"morgan2": (0, 2048), "morgan3": (2048, 3072), "maccs": (3072, 3239)})
    blocks_v2: dict = field(default_factory=lambda: {"morgan2": (0, 2048), "morgan3": (2048, 3072), "maccs": (3072, 3239), "atompair": (3239, 5287), "torsion": (5287, 7335), "fcfp": (7335, 9383)})

    @property
    def bins(self) -> int:
        return int(self.max_mz / self.bin_width) + 1

    def adducts(self) -> list[tuple[str, int, int, float]]:
        return [(a, n, z, s if self.compat_adducts else CORRECTED.get(a, s)) for a, n, z, s in ADDUCTS]


DEFAULT = EngineConfig()
