"""Readers and writers: sheets, polygons, rain payloads, saved tables and exports."""
