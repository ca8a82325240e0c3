"""Readers and writers of weather, points, rays and result cubes."""
