"""Readers and writers: GFF3, GFF2 and GTF, FASTA, evaluation reports, registries and manifests."""
