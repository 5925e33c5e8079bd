"""Composable DataFrame operators over a catalogue of venues, offers and weekly schedules."""
