"""Every operator over the driver's tables, next to SQL that computes the same."""
