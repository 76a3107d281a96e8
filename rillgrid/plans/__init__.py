"""Plans of several jobs: written tables, path doubling and whole assessments."""
