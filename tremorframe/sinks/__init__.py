"""Writers: tables, prediction lines, manifests and contract checks."""
