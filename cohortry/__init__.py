"""cohortry: behavioural segmentation of wide user-activity tables on Spark."""
