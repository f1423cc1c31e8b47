"""studybank."""
