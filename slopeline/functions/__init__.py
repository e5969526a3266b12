"""Column -> Column functions: text, calendar, geometry, scoring, validation."""
