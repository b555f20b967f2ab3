"""Line-ownership and code-change analytics on PySpark."""
