"""Alphabets, residue reduction, genetic codes and sequence text functions (Catalyst expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMINO = "ARNDCQEGHILKMFPSTWYVBJZX*_"
DNA = "ACGTN"

# Groups of residues that share a seed letter.
REDUCTIONS = {
    "murphy10": "A KR EDNQ C G H ILVM FYW P ST",
    "steinegger12": "AST C DN EQ FY G H IV KR LM P W",
    "none": "A S T C D N E Q F Y G H I V K R L M P W",
}

# Amino acids of the 64 codons, bases in the order T C A G, by NCBI code number.
GENETIC_CODES = {
    1: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    2: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
    3: "FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    4: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    5: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG",
    6: "FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    9: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    10: "FFLLSSSSYY**CCCWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    11: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    12: "FFLLSSSSYY**CC*WLLLSPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    13: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSGGVVVVAAAADDEEGGGG",
    14: "FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    16: "FFLLSSSSYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    21: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    22: "FFLLSS*SYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    23: "FF*LSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    24: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSSKVVVVAAAADDEEGGGG",
    25: "FFLLSSSSYY**CCGWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    26: "FFLLSSSSYY**CC*WLLLAPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
}


def text_to_residues(text: Column) -> Column:
    """ASCII letters of a text as residues: upper case, U and O become X."""
    return F.translate(F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", "")), "UO", "XX")


def clean_protein(seq: Column) -> Column:
    """Protein letters as read from a file; a character outside the alphabet raises an error."""
    s = F.translate(F.upper(F.regexp_replace(seq, r"[\s]", "")), "UO-", "XXX")
    return F.when(s.rlike(r"^[ARNDCQEGHILKMFPSTWYVBJZX*_]*$"), s).otherwise(F.raise_error(F.concat(F.lit("invalid character in sequence: "), s)))


def clean_dna(seq: Column) -> Column:
    s = F.translate(F.upper(F.regexp_replace(seq, r"[\s]", "")), "MRWSYKVHDBX", "NNNNNNNNNNN")
    return F.when(s.rlike(r"^[ACGTN]*$"), s).otherwise(F.raise_error(F.concat(F.lit("invalid character in sequence: "), s)))


def reduction_map(name: str = "murphy10") -> tuple[str, str]:
    """(letters, group letters): each group goes by its first letter; B, J and Z fall into the first group."""
    groups = REDUCTIONS[name].split()
    pairs = [(c, g[0]) for g in groups for c in g] + [(c, groups[0][0]) for c in "BJZ"]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def reduce_residues(seq: Column, name: str = "murphy10") -> Column:
    return F.translate(seq, *reduction_map(name))


def reverse_complement(dna: Column) -> Column:
    return F.reverse(F.translate(dna, "ACGT", "TGCA"))


def translate_codons(dna: Column, code: int = 1) -> Column:
    """Protein of a reading frame that starts at the first base. A codon with N is X unless its third base is free."""
    if code not in GENETIC_CODES:
        raise ValueError("Invalid genetic code id.")
    letters = GENETIC_CODES[code]
    order = "TCAG"
    table = {a + b + c: letters[16 * i + 4 * j + k] for i, a in enumerate(order) for j, b in enumerate(order) for k, c in enumerate(order)}
    for a in order:
        for b in order:
            of = {table[a + b + c] for c in order}
            if len(of) == 1:
                table[a + b + "N"] = of.pop()
    lookup = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])
    codons = F.regexp_extract_all(dna, F.lit("[ACGTN]{3}"), F.lit(0))
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.element_at(lookup, c), F.lit("X"))), "")


def accession(seqid: Column) -> Column:
    """Accession of a sequence id: UniRef prefix, gi|n|, db|acc|name, :PDB= and a version after the last dot are dropped."""
    a = F.regexp_replace(seqid, r"^UniRef[0-9]+_", "")
    a = F.regexp_replace(a, r"^gi\|[0-9]+\|", "")
    a = F.when(a.rlike(r"^[a-z]+\|[^|]+"), F.regexp_extract(a, r"^[a-z]+\|([^|]+)", 1)).otherwise(a)
    a = F.regexp_replace(a, r":PDB=.*$", "")
    return F.regexp_replace(a, r"\.[^.]*$", "")


def seqid_of(title: Column) -> Column:
    """First word of a title, up to white space or a \\x01 between merged deflines."""
    return F.regexp_extract(title, r"^([^\s\x01]*)", 1)


def deflines(title: Column) -> Column:
    return F.split(title, r"\x01| >")


def clean_title(title: Column) -> Column:
    t = F.regexp_replace(title, r"^[\x00-\x20]+", "")
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, F.lit("N/A")).otherwise(F.replace(t, F.lit("\t"), F.lit("\\t")))


def residue_count(seq: Column, residue: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(residue), F.lit("")))
