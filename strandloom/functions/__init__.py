"""Column functions: nucleotide strings, attribute strings, names, label ids and logits."""
