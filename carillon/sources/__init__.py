"""Where signals come from: tables, WAV files, generators, experiment definitions."""
