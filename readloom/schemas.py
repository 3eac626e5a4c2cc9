"""Table schemas and flag bits. Coordinates inside the engine are 0-based and half-open; ``pos`` of a read is 1-based."""

PAIRED, PROPER, UNMAPPED, REVERSE, FIRST = 1, 2, 4, 16, 64
SECONDARY, QCFAIL, DUPLICATE, SUPPLEMENTARY = 256, 512, 1024, 2048

ALIGNMENTS = (
    "sample STRING, qname STRING, flag INT, ref_id INT, chrom STRING, pos BIGINT, mapq INT, cigar STRING, seq_len INT, ref_span INT, "
    "mate_pos BIGINT, tlen INT, cb STRING, rg STRING, tags MAP<STRING,STRING>, raw BINARY"
)
REFS = "ref_id INT, chrom STRING, length BIGINT"
SIGNAL = "chrom STRING, start BIGINT, end BIGINT, score DOUBLE"
TRACK = "chrom STRING, start BIGINT, end BIGINT, value FLOAT"
INDEX_STATS = "sample STRING, ref_id INT, chrom STRING, length BIGINT, mapped BIGINT, unmapped BIGINT"
