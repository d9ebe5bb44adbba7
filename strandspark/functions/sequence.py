"""Sequence functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The standard genetic code, codons in the order of T, C, A, G at each place. Fixed values.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: One-letter code to three letters and name. Fixed values.
AMINO_NAMES = {
    "A": ("Ala", "Alanine"), "R": ("Arg", "Arginine"), "N": ("Asn", "Asparagine"), "D": ("Asp", "Aspartic acid"), "C": ("Cys", "Cysteine"),
    "Q": ("Gln", "Glutamine"), "E": ("Glu", "Glutamic acid"), "G": ("Gly", "Glycine"), "H": ("His", "Histidine"), "I": ("Ile", "Isoleucine"),
    "L": ("Leu", "Leucine"), "K": ("Lys", "Lysine"), "M": ("Met", "Methionine"), "F": ("Phe", "Phenylalanine"), "P": ("Pro", "Proline"),
    "S": ("Ser", "Serine"), "T": ("Thr", "Threonine"), "W": ("Trp", "Tryptophan"), "Y": ("Tyr", "Tyrosine"), "V": ("Val", "Valine"), "*": ("***", "Stop"),
}
#: What the three stop codons are called. Fixed values.
STOP_NAMES = {"TAA": "Stop (Ochre)", "TAG": "Stop (Amber)", "TGA": "Stop (Opal)"}
#: Bases in the order in which variants and k-mers are listed. Fixed value.
LISTED = "ATGC"
CODONS = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}


def revcomp(seq: Column) -> Column:
    """Reverse complement; symbols other than ACGT stay, case stays."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def codon_name(codon: Column) -> Column:
    """The full name of a codon's amino acid, stop codons by their own names; null for no codon."""
    names = {c: STOP_NAMES.get(c, AMINO_NAMES[a][1]) for c, a in CODONS.items()}
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), codon)


def slice_(seq: Column, start: int | None, end: int | None) -> Column:
    """1-based, both ends included; 0 or None: from the first base, to the last."""
    return F.substring(seq, F.lit(start or 1), F.greatest(F.lit(0), (F.lit(end) if end else F.length(seq)) - (start or 1) + 1))


def codon_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in CODONS.items() for x in pair])


def pieces(seq: Column, size: int, overlap: int = 0) -> Column:
    """Array of stretches of size, each with the next overlap symbols; places in a string are found by walking, so long strings are cut first."""
    n = F.ceil(F.length(seq) / size).cast("int")
    return F.when(
        n > 0,
        F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda j: F.substring(seq, j * size + 1, F.lit(size + overlap))),
    ).otherwise(F.array().cast("array<string>"))


def codons(seq: Column) -> Column:
    """Array of codons, a last shorter one included."""
    return F.flatten(
        F.transform(
            pieces(seq, 300),
            lambda c: F.transform(
                F.sequence(F.lit(0), F.ceil(F.length(c) / 3).cast("int") - 1), lambda k: F.substring(c, k * 3 + 1, F.lit(3))
            ),
        ),
    )


def translate(seq: Column, table: Column | None = None) -> Column:
    """One-letter amino acids of whole codons; unknown codons give X."""
    whole = F.substring(seq, F.lit(1), (F.floor(F.length(seq) / 3) * 3).cast("int"))
    table = codon_map() if table is None else table
    return F.array_join(F.transform(codons(whole), lambda c: F.coalesce(F.element_at(table, c), F.lit("X"))), "")


def codon_variants(codon: Column, base_from: str | None = None, base_to: str | None = None) -> Column:
    """Array of the codons one base away, by place and then target base; from: only places that hold it, to: only that target."""
    out = []
    for place in range(3):
        for base in LISTED:
            if base_to and base != base_to:
                continue
            old = F.substring(codon, place + 1, 1)
            changed = F.concat(F.substring(codon, 1, place), F.lit(base), F.substring(codon, place + 2, 3))
            ok = (old != base) & ((old == base_from) if base_from else F.lit(True))
            out.append(F.when(ok, changed))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def classified_variants(rows: DataFrame, codon: str) -> DataFrame:
    """rows for each variant of the codon column: variant, aa_from, aa_to, kind (synonymous, nonsense, nonsynonymous)."""
    out = rows.withColumn("variant", F.explode(codon_variants(F.col(codon)))).withColumns(
        {"aa_from": F.element_at(codon_map(), F.col(codon)), "aa_to": F.element_at(codon_map(), F.col("variant"))}
    )
    kind = F.when(F.col("aa_from") == F.col("aa_to"), "synonymous").when(F.col("aa_to") == "*", "nonsense").otherwise("nonsynonymous")
    return out.withColumn("kind", kind)


def one_away(rows: DataFrame, seq: str, target: str) -> DataFrame:
    """rows with index, codon, place for each codon of seq that is one substitution, at that place from 1, away from target."""
    out = rows.select("*", F.posexplode(codons(F.col(seq))).alias("index", "codon")).where(F.length("codon") == len(target))
    same = [F.substring("codon", k + 1, 1) == F.lit(target[k]) for k in range(3)]
    place = F.coalesce(*[F.when(~same[k] & same[(k + 1) % 3] & same[(k + 2) % 3], F.lit(k + 1)) for k in range(3)])
    return out.withColumn("place", place).where("place is not null")


def ungapped(seq: Column, gap: str = "-") -> Column:
    return F.replace(seq, F.lit(gap), F.lit(""))


def gap_map(seq: Column, gap: str = "-") -> Column:
    """Array: the column of each ungapped base, from 0."""
    return F.filter(
        F.when(F.length(seq) > 0, F.sequence(F.lit(0), F.length(seq) - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.substring(seq, i + 1, F.lit(1)) != gap,
    )


#: Windows are read from stretches so long: places in a string are found by walking.
STRETCH = 64


def kmers(seq: Column, k: int) -> Column:
    """Array of all k-mers in their order; windows() gives them as rows, faster."""
    none = F.array().cast("array<string>")
    each = lambda c: F.when(
        F.length(c) >= k,
        F.transform(F.sequence(F.lit(0), F.greatest(F.length(c) - k, F.lit(0))), lambda i: F.substring(c, i + 1, F.lit(k))),
    ).otherwise(none)
    return F.flatten(F.transform(pieces(seq, 256, k - 1), each))


def spread(rows: DataFrame) -> DataFrame:
    """rows over as many partitions as there are cores, where a scan gives fewer: what follows makes many rows of one."""
    session = rows.sparkSession
    cores = session.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(
        max(cores, int(session.conf.get("spark.sql.shuffle.partitions"))),
        F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")]),
    )


def windows(rows: DataFrame, width: int, seq: str = "seq", mirrored: dict[str, str] | None = None) -> DataFrame:
    """Other columns of rows, pos from 0 and w: every window of that width.

    mirrored: a map of symbols; adds m, the window reversed with its symbols mapped. Stretches are mapped once, not each window.
    """
    keep = [c for c in rows.columns if c != seq]
    cut = spread(rows).select(*keep, F.posexplode(pieces(F.col(seq), STRETCH, width - 1)).alias("_k", "_c")).where(F.length("_c") >= width)
    if mirrored:
        cut = cut.withColumn("_d", F.translate("_c", "".join(mirrored), "".join(mirrored.values())))
    each = cut.select("*", F.explode(F.sequence(F.lit(1), F.length("_c") - width + 1)).alias("_i"))
    at = lambda c: F.substring(F.col(c), F.col("_i"), F.lit(width))
    return each.select(
        *keep,
        (F.col("_k") * STRETCH + F.col("_i") - 1).alias("pos"),
        at("_c").alias("w"),
        *([F.reverse(at("_d")).alias("m")] if mirrored else []),
    )


def canonical(kmer: Column) -> Column:
    """The first of a k-mer and its reverse complement in the order A, T, G, C."""
    order = lambda x: F.translate(x, "ATGC", "0123")
    return F.translate(F.least(order(kmer), order(revcomp(kmer))), "0123", "ATGC")


def acgt_only(seq: Column) -> Column:
    return ~seq.rlike("[^ACGTacgt]")


def base_name(path: Column) -> Column:
    """Last part of a path without its last extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
