"""Nothing beyond the shared session; the corpus operators' tests can be deleted with their subpackage."""
