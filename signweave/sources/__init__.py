"""Edge lists in, reports out."""
