"""Path names, orientation, edges and k-mers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shape of a path name (sample, haplotype, sequence) and of trailing coordinates.
NAME = r"^([^#]+)(#[^#]+)?(#[^#].*)?$"
COORDS = r"^(.+):([0-9]+)-([0-9]+)$"


def _part(name: Column, k: int) -> Column:
    return F.nullif(F.regexp_extract(name, NAME, k), F.lit(""))


def parse_name(name: Column) -> Column:
    """struct(sample, hap, seqid, start, end). Coordinates belong to the last part that is present."""
    hap, seqid = F.substring(_part(name, 2), 2, 1 << 30), F.substring(_part(name, 3), 2, 1 << 30)
    shaped = name.rlike(NAME)
    sample = F.when(shaped, _part(name, 1)).otherwise(name)
    last = F.coalesce(seqid, hap, sample)
    has = shaped & last.rlike(COORDS)
    bare = F.when(has, F.regexp_extract(last, COORDS, 1)).otherwise(last)
    return F.struct(
        F.when(seqid.isNull() & hap.isNull(), bare).otherwise(sample).alias("sample"),
        F.when(seqid.isNull() & hap.isNotNull(), bare).otherwise(hap).alias("hap"),
        F.when(seqid.isNotNull(), bare).alias("seqid"),
        F.when(has, F.regexp_extract(last, COORDS, 2).cast("long")).alias("start"),
        F.when(has, F.regexp_extract(last, COORDS, 3).cast("long")).alias("end"),
    )


def path_id(sample: Column, hap: Column, seqid: Column) -> Column:
    """sample#hap#seqid without what is absent; '*' stands for a haplotype that only lacks its name."""
    return (
        F.when(hap.isNotNull() & seqid.isNotNull(), F.concat_ws("#", sample, hap, seqid)).when(hap.isNotNull(), F.concat_ws("#", sample, hap))
        .when(seqid.isNotNull(), F.concat_ws("#", sample, F.lit("*"), seqid)).otherwise(sample)
    )


def display(id_: Column, start: Column, end: Column) -> Column:
    return F.when(start.isNotNull() & end.isNotNull(), F.concat(id_, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))).otherwise(id_)


def forward(sign: Column) -> Column:
    return F.when(sign.isin("+", ">"), True).when(sign.isin("-", "<"), False)


def arrow(fwd: Column) -> Column:
    return F.when(fwd, ">").otherwise("<")


def canonical_edge(u: Column, u_fwd: Column, v: Column, v_fwd: Column) -> Column:
    """struct(u, u_fwd, v, v_fwd) read in the direction that starts at the smaller node."""
    turn = (u > v) | ((u == v) & ~u_fwd)
    here = F.struct(u.alias("u"), u_fwd.alias("u_fwd"), v.alias("v"), v_fwd.alias("v_fwd"))
    back = F.struct(v.alias("u"), (~v_fwd).alias("u_fwd"), u.alias("v"), (~u_fwd).alias("v_fwd"))
    return F.when(turn, back).otherwise(here)


def edge_label(u: Column, u_fwd: Column, v: Column, v_fwd: Column) -> Column:
    return F.concat(arrow(u_fwd), u.cast("string"), arrow(v_fwd), v.cast("string"))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def canonical_kmer(seq: Column) -> Column:
    return F.least(seq, reverse_complement(seq))


def kmer_code(seq: Column) -> Column:
    """Two bits a base, A C G T as 0 to 3, first base highest; other letters give null."""
    bits = F.transform(F.split(F.upper(seq), ""), lambda c: F.when(c != "", F.nullif(F.instr(F.lit("ACGT"), c) - 1, F.lit(-1))))
    return F.aggregate(F.filter(bits, lambda b: F.lit(True)), F.lit(0).cast("long"), lambda a, b: a * 4 + b)


def code_reverse_complement(code: Column, k: int) -> Column:
    """The code of the reverse complement: pairs of bits in turned order, each taken from 3."""
    return sum((F.shiftleft(3 - F.pmod(F.shiftright(code, 2 * i), F.lit(4)), 2 * (k - 1 - i)) for i in range(k)), F.lit(0).cast("long"))


def canonical_code(code: Column, k: int) -> Column:
    return F.least(code, code_reverse_complement(code, k))


def kmer_text(code: Column, k: int) -> Column:
    return F.concat(*[F.substring(F.lit("ACGT"), F.pmod(F.shiftright(code, 2 * (k - 1 - i)), F.lit(4)).cast("int") + 1, F.lit(1)) for i in range(k)])


def ends(seq: Column, k: int) -> Column:
    """The first and last k bases of a node."""
    return F.struct(F.substring(seq, 1, k).alias("left"), F.right(seq, F.lit(k)).alias("right"))
