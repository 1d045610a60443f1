"""framelake: episodic, frame-indexed sensor data and corpus preparation on PySpark."""
