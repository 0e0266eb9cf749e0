"""The list algebra and what is planned from it: compiled queries, specs, splits and rendered code."""
