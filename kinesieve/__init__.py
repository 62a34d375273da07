"""Part of kinesieve."""
