"""Retention analytics as Spark jobs: features, scoring, cohorts, experiments, models."""
