"""cloakframe: tabular privacy protection and measurement as Spark jobs."""
