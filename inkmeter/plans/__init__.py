"""Report assembly over finished results: control plane, not data plane."""
