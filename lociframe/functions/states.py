"""Character codes: nucleotides, amino acids and discrete trait states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC nucleotide codes as unions of A=1, C=2, G=4, T=8.
NUCLEOTIDE_MASKS = {
    "A": 1, "C": 2, "G": 4, "T": 8, "U": 8,
    "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3,
    "B": 14, "D": 13, "H": 11, "V": 7,
    "N": 15, "O": 15, "X": 15, "-": 15, "?": 15,
}

# Amino acids in bit order, then the unions B, Z and "unknown".
AMINO_ACID_ORDER = "ARNDCQEGHILKMFPSTWYV"
AMINO_ACID_MASKS = {aa: 1 << i for i, aa in enumerate(AMINO_ACID_ORDER)} | {
    "B": 0b1100, "Z": 0b1100000, "*": 0xFFFFF, "-": 0xFFFFF, "?": 0xFFFFF, "X": 0xFFFFF,
}

MISSING_DNA = "^[-?NXnx]*$"
MISSING_AA = "^[-?]*$"

_HEX = "0123456789abcdef"


def _masks(dtype: str) -> dict[str, int]:
    return NUCLEOTIDE_MASKS if dtype == "DNA" else AMINO_ACID_MASKS


def state_mask(base: Column, dtype: str = "DNA") -> Column:
    """Bit mask of one character; NULL when the character is illegal."""
    table = _masks(dtype)
    pairs = [F.lit(x) for k, v in table.items() for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs), F.upper(base))


def is_missing(sequence: Column, dtype: Column) -> Column:
    return F.when(dtype == "AA", sequence.rlike(MISSING_AA)).otherwise(sequence.rlike(MISSING_DNA))


def illegal_characters(sequence: Column, dtype: str = "DNA") -> Column:
    legal = "".join(_masks(dtype)).replace("-", "") + "-"
    return F.translate(F.upper(sequence), legal, "")


def encode_text(sequence: Column, dtype: str = "DNA") -> Column:
    """Replace every character by one character per *state set*.

    DNA becomes hexadecimal digits of the mask; amino acids keep their letter
    with all unknowns written ``X``.  Equal codes are equal state sets, which is
    what pattern compression compares.
    """
    bad = illegal_characters(sequence, dtype)
    if dtype == "DNA":
        letters, digits = "".join(NUCLEOTIDE_MASKS), "0123456789"
        # digits of the input are no codes: they are made illegal before the codes are looked at
        coded = F.translate(F.upper(sequence), letters + digits, "".join(_HEX[NUCLEOTIDE_MASKS[c]] for c in letters) + "!" * len(digits))
        legal = f"^[{_HEX}]*$"
    else:
        coded = F.translate(F.upper(sequence), "*-?", "XXX")
        legal = f"^[{AMINO_ACID_ORDER}BZX]*$"
    return F.when(coded.rlike(legal), coded).when(bad == "", coded).otherwise(
        F.raise_error(F.concat(F.lit("illegal sequence characters: "), bad))
    )


def code_mask(code: Column, dtype: str = "DNA") -> Column:
    """Mask of one character produced by :func:`encode_text`."""
    if dtype == "DNA":
        return F.instr(F.lit(_HEX), code) - 1
    return state_mask(code, "AA")


AMBIGUOUS_CODE = "[35679abcdef]"
